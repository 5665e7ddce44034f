"""Triage by a table of phrases: one pass over a text finds all phrases that occur, and the rules that fire first."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.text import MARKED, PLAIN

#: Stands for white space, at both ends and around every sign: "a b" is read as "|a|b|", "l'a" as "|l|'|a|", "l 'a" as "|l||'|a|".
EDGE = "\x01"
#: White space (fixed values), which becomes an edge, and what an edge in the text itself becomes: a sign of no phrase.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NO_EDGE = "\x02"

#: Words that may never be what leaves an announcement of aid out (fixed values): tenders and contracts.
TENDERS = r"(?<!\w)(gara|gare|appalt\w*)(?!\w)"


class RuleError(ValueError):
    """A table of rules that cannot be used; the message says where."""


@dataclass(frozen=True)
class Rule:
    """Fires where phrase occurs and, if there are needs, one of them too.  A phrase stands between word borders, blanks
    for any white space; a * at its end stands for any ending of the last word."""

    section: str
    group: str
    phrase: str
    needs: tuple[str, ...] = ()


def plain(text: str) -> str:
    """What the column expression ``fold`` gives for a text."""
    return text.lower().translate(str.maketrans("’‘`´" + MARKED, "''''" + PLAIN))


def read_rules(table: dict[str, list[dict]], relevant: str = "relevant", business: str = "business", private: str = "private", other: str = "other") -> list[Rule]:
    """The rules of {section: [{"group": name, "words": [phrase], "with": [phrase]}]}, in the order of the table."""
    if unknown := sorted(set(table) - {relevant, business, private, other}):
        raise RuleError(f"unknown sections: {', '.join(unknown)}")
    out = []
    for section in (relevant, business, private, other):
        for entry in table.get(section) or []:
            if not isinstance(entry, dict) or not entry.get("group") or not isinstance(entry.get("words"), list):
                raise RuleError(f"{section}: every entry has a group and a list of words")
            needs = tuple(p for p in (str(x).strip() for x in entry.get("with") or []) if p)
            for phrase in filter(None, (str(x).strip() for x in entry["words"])):
                if section == private and re.search(TENDERS, plain(phrase)):
                    raise RuleError(f"{section}: {phrase!r} would leave out aid that is filed under tenders")
                for p in (phrase, *needs):
                    if not re.search(r"\w", plain(p)):
                        raise RuleError(f"{section}: {p!r} holds no word")
                out.append(Rule(section, entry["group"], phrase, needs))
    for needed in (relevant, other):
        if not any(r.section == needed for r in out):
            raise RuleError(f"{needed}: no phrase")
    return out


def _needle(phrase: str) -> tuple[str, str, bool]:
    """(anchor, needle, open): the longest whole word of a phrase (or its only, unfinished one: open), and how the phrase
    reads between edges; a sign at its end has two edges beside it just where no word follows or goes before."""
    stem = " ".join(plain(phrase.rstrip("*")).replace(EDGE, NO_EDGE).split())
    unfinished = phrase.endswith("*") and bool(re.search(r"\w$", stem))
    words = re.findall(r"\w+", stem)
    whole = words[:-1] if unfinished else words
    needle = EDGE + re.sub(r"[^\w ]", lambda m: EDGE + m[0] + EDGE, stem).replace(" ", EDGE) + EDGE
    return max(whole or words, key=len), needle.rstrip(EDGE) if phrase.endswith("*") else needle, not whole


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body reads it."""
    return F.transform(F.array(value), body)[0]


def phrases_found(text: Column, phrases: list[str]) -> Column:
    """The numbers (places in ``phrases``) of the phrases that occur in a text, ascending; null texts hold none.

    A text is cut into its different words once; phrases are looked up by their rarest-looking word (unfinished words by
    their first letters), and only those that are met are searched for in the text.  So the time grows with the text
    and the phrases met, not with text times phrases.  No shuffle and no join: copies and null keys need no care.
    """
    parts = [(i, *_needle(p)) for i, p in enumerate(phrases)]
    stems = [anchor for _, anchor, _, unfinished in parts if unfinished]
    shortest = min(map(len, stems), default=0)
    key = lambda anchor, unfinished: "*" + anchor[:shortest] if unfinished else anchor
    table = [(i, key(anchor, unfinished), needle) for i, anchor, needle, unfinished in parts]
    if not table:
        return F.array().cast("array<int>")
    keys = F.array(*[F.lit(k) for k in sorted({k for _, k, _ in table})])
    letters = F.translate(F.lower(F.coalesce(text, F.lit(""))), EDGE + SPACES + "’‘`´" + MARKED, NO_EDGE + EDGE * len(SPACES) + "''''" + PLAIN)
    signs = rf"(?U)[^a-z0-9_{EDGE}](?<!\w)"
    edged = F.concat(F.lit(EDGE), F.regexp_replace(F.regexp_replace(letters, EDGE + EDGE + "+", EDGE), signs, EDGE + "$0" + EDGE), F.lit(EDGE))

    def met(words: Column) -> Column:
        begun = F.transform(F.filter(words, lambda w: F.length(w) >= shortest), lambda w: F.concat(F.lit("*"), F.substring(w, 1, shortest)))
        return F.array_intersect(F.concat(words, begun) if stems else words, keys)

    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("key"), F.lit(n).alias("needle")) for i, k, n in table])
    hits = lambda e, words: F.filter(rows, lambda p: F.array_contains(words, p["key"]) & e.contains(p["needle"]))
    ids = lambda e, words: F.transform(hits(e, words), lambda p: p["id"])
    return _once(edged, lambda e: _once(_once(F.array_distinct(F.split(e, EDGE)), met), lambda words: ids(e, words)))


def first_rules(text: Column, rules: list[Rule]) -> Column:
    """A struct with a field for each section: the first of its rules that fires, as ``section/group: 'phrase'`` (and
    ``+ 'need'``, the first one found), or null."""
    phrases = list(dict.fromkeys(p for r in rules for p in (r.phrase, *r.needs)))
    number = {p: i for i, p in enumerate(phrases)}
    need = lambda p: F.struct(F.lit(number[p]).alias("id"), F.lit(f" + '{p}'").alias("text"))
    none = F.array().cast("array<struct<id:int,text:string>>")

    def first(section: str, found: Column) -> Column:
        table = F.array(*[
            F.struct(F.lit(number[r.phrase]).alias("id"), F.lit(f"{r.section}/{r.group}: '{r.phrase}'").alias("text"), (F.array(*map(need, r.needs)) if r.needs else none).alias("needs"))
            for r in rules if r.section == section
        ])
        holds = lambda x: F.array_contains(found, x["id"])
        fires = F.filter(table, lambda r: holds(r) & ((F.size(r["needs"]) == 0) | F.exists(r["needs"], holds)))
        return _once(F.get(fires, F.lit(0)), lambda r: F.concat(r["text"], F.coalesce(F.get(F.filter(r["needs"], holds), F.lit(0))["text"], F.lit(""))))

    sections = list(dict.fromkeys(r.section for r in rules))
    return _once(phrases_found(text, phrases), lambda found: F.struct(*[first(s, found).alias(s) for s in sections]))


def triage_decision(text: Column, rules: list[Rule], relevant: str = "relevant", business: str = "business", private: str = "private", other: str = "other") -> Column:
    """outcome, reason and overruled of a text, by the rules of four sections.

    A relevant rule makes it relevant, unless a private one fires and no business one: then it is not_relevant by the
    private rule, and overruled names the relevant one.  Without a relevant rule one of the others makes it
    not_relevant; without any it is to_review and has no reason.
    """
    present = {r.section for r in rules}

    def decide(hit: Column) -> Column:
        rule = lambda s: hit[s] if s in present else F.lit(None).cast("string")
        veto = rule(relevant).isNotNull() & rule(private).isNotNull() & rule(business).isNull()
        outcome = F.when(veto, "not_relevant").when(rule(relevant).isNotNull(), "relevant").when(rule(other).isNotNull(), "not_relevant").otherwise("to_review")
        reason = F.when(veto, rule(private)).otherwise(F.coalesce(rule(relevant), rule(other)))
        return F.struct(outcome.alias("outcome"), reason.alias("reason"), F.when(veto, rule(relevant)).alias("overruled"))

    return _once(first_rules(text, rules), decide)
