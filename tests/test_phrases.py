"""Phrase rules against one pattern for each phrase, in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import phrases as ph

TABLE = {
    "relevant": [
        {"group": "grants", "words": ["contribut*", "fondo perduto", "credito d'imposta", "fse+"]},
        {"group": "calls", "words": ["bando", "avviso pubblic*"], "with": ["imprese", "piccole e med*"]},
        {"group": "odd", "words": ["+ fse", "a*", "R&S", "più"]},
    ],
    "business": [{"group": "firms", "words": ["imprese", "partita iva"]}],
    "private": [{"group": "homes", "words": ["affitt*", "libri di testo"]}],
    "other": [{"group": "posts", "words": ["concors*", "gara d'appalto"]}],
}


def pattern(phrase):
    stem = ph.plain(phrase.rstrip("*"))
    body = r"\s+".join(re.escape(w) for w in stem.split()) + (r"\w*" if phrase.endswith("*") else "")
    return re.compile(r"(?<!\w)" + body + r"(?!\w)")


def first(rules, section, text):
    for r in rules:
        if r.section == section and pattern(r.phrase).search(text):
            name = f"{r.section}/{r.group}: '{r.phrase}'"
            if not r.needs:
                return name
            for n in r.needs:
                if pattern(n).search(text):
                    return f"{name} + '{n}'"
    return None


def decision(rules, text):
    t = ph.plain(text or "")
    hit = {s: first(rules, s, t) for s in TABLE}
    if hit["relevant"]:
        if hit["private"] and not hit["business"]:
            return "not_relevant", hit["private"], hit["relevant"]
        return "relevant", hit["relevant"], None
    return ("not_relevant", hit["other"], None) if hit["other"] else ("to_review", None, None)


def test_decisions_equal_patterns(spark):
    rules = ph.read_rules(TABLE)
    rng = random.Random(5)
    bits = ["contributo", "Contributi", "fondo", "perduto", "credito", "d'imposta", "d’imposta", "fse", "fse+", "+", "bando", "avviso", "pubblico", "imprese", "imprese2",
            "piccole", "e", "medie", "partita", "iva", "affitto", "libri", "di", "testo", "concorsi", "gara", "d'appalto", "R&S", "r & s", "PIÙ", "piu_", "x", "\x01", "perduto\x01", "\x02", "b", "c"]
    gaps = [" ", " ", " ", "  ", "\n", "\t ", ", ", "-", "", "'", "\x01", "\u2003", "+"]
    texts = [None, "", " ", "\n+ fse\n", "fse+", "fse+x", "x+ fse", "fondo perduto", "fondo, perduto", "sfondo perduto", "fondo perduto", "a" * 100_000 + " fondo perduto"]
    texts += ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {r.id: (r.d.outcome, r.d.reason, r.d.overruled) for r in df.select("id", ph.triage_decision(F.col("text"), rules).alias("d")).collect()}
    want = {i: decision(rules, t) for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert {w[0] for w in want.values()} == {"relevant", "not_relevant", "to_review"} and any(w[2] for w in want.values())


def test_many_phrases_are_found_by_number(spark):
    phrases = [f"w{i}" if i % 3 else f"w{i} w{i + 1}" if i % 2 else f"w{i}*" for i in range(400)]
    text = " ".join(f"w{i}" for i in range(0, 400, 7)) + " w6 w7 w90 w91"
    got = spark.createDataFrame([(text,)], "text string").select(ph.phrases_found(F.col("text"), phrases).alias("f")).first().f
    assert got == [i for i, p in enumerate(phrases) if pattern(p).search(text)]


@pytest.mark.parametrize(("table", "says"), [
    ({"relevant": [], "other": [{"group": "g", "words": ["a"]}]}, "no phrase"),
    ({"what": []}, "unknown"),
    ({"relevant": [{"words": ["a"]}]}, "group"),
    ({"relevant": [{"group": "g", "words": ["+"]}], "other": [{"group": "g", "words": ["a"]}]}, "no word"),
    ({"relevant": [{"group": "g", "words": ["a"]}], "private": [{"group": "g", "words": ["gara d'appalto"]}], "other": [{"group": "g", "words": ["a"]}]}, "tenders"),
])
def test_rule_tables_that_cannot_be_used(table, says):
    with pytest.raises(ph.RuleError, match=says):
        ph.read_rules(table)


def test_no_python_worker_and_no_shuffle(spark):
    plan = spark.range(3).select(ph.triage_decision(F.col("id").cast("string"), ph.read_rules(TABLE)).alias("d"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
