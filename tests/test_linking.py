"""Linking against the rules of SURVEY A.10 and E6 in plain Python: every announcement compared with every one linked before."""

import collections
import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import notices, titles
from noticeworks.operators import linking

YEAR = 2026


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("’", "'")) if not unicodedata.combining(c))


def parse(title, issuer):
    text = plain(re.sub("([a-z])([A-Z])", r"\1 \2", title))
    years, marks = set(re.findall(titles.YEAR, text)), set()
    for before, noun, noun_2, behind in re.findall(titles.EDITION, text):
        n = before or behind
        marks.add((noun or noun_2) + str(titles.ORDINALS.get(n, n)))
    for noun, n in re.findall(titles.PART, text):
        marks.add(("n" if noun in ("n", "nr", "numero") else noun) + n)
    for _, pattern in notices.ROLES:
        text = re.sub(pattern, " ", text)
    for pattern in (titles.YEAR, titles.EDITION, titles.PART):
        text = re.sub(pattern, " ", text)
    own = set(issuer.split()) - {"camera", "regione", "comune", "provincia"}
    words = {w for w in re.findall("[a-z0-9]+", text) if len(w) > 1} - set(titles.TITLE_WORDS) - {"cciaa", "camera", "commercio", "regione", "comune"}
    return words - own, years, marks, words & own


def role_of(title):
    return next((name for name, pattern in notices.ROLES if re.search(pattern, plain(title))), None)


def share(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def alike(a, b):
    small = min(len(a), len(b))
    return max(share(a, b), 0.9 * len(a & b) / small if small >= 4 else 0)


def fits(x, y):
    return not x or not y or x <= y or y <= x


def in_order(rows, before=()):
    """id -> (call, how, doubt).  before: rows with their call."""
    often = collections.Counter((r[1], u) for r in [*rows, *(b[:-1] for b in before)] for u in set(r[4]))
    bad = {u for (_, u), n in often.items() if n > 1}
    calls, out = {}, {}

    def item(r):
        i, source, issuer, place, urls, code, title, seen = r
        return dict(id=i, source=source, issuer=issuer or "", place=place or "", urls=sorted(set(urls) - bad), code=code, title=parse(title or "", issuer or ""), role=role_of(title or ""), text=title or "")

    def decide(a):
        words, years, marks, places = a["title"]
        for call, known in calls.items():
            if a["code"] and any(b["code"] == a["code"] for b in known):
                return first_with(lambda b: b["code"] == a["code"]), "code", None
        for u in a["urls"]:
            call = first_with(lambda b: u in b["urls"])
            if call is not None:
                return (None, "doubt", call) if max(alike(words, b["title"][0]) for b in calls[call]) < 0.2 else (call, "url", None)
        best = (0, None, None)
        for call, known in calls.items():
            for b in known:
                w, y, m, p = b["title"]
                near = a["place"] == b["place"] or {"ITA", "UE"} & {a["place"], b["place"]} or {a["place"], b["place"]} <= {"TAA", "TN", "BZ"}
                kind = a["issuer"].split(" ")[0]
                rivals = kind in ("camera", "comune", "provincia") and kind == b["issuer"].split(" ")[0] and a["issuer"] != b["issuer"]
                if not near or (a["code"] and b["code"] and a["code"] != b["code"]) or not fits(years, y) or (marks and m and marks != m) or (places and p and not places & p):
                    continue
                if (rivals and share(words, w) < 0.9) or (a["source"] == b["source"] and share(words, w) < 0.8 and not a["role"]):
                    continue
                s = alike(words, w)
                if a["role"] and len(w) >= 2 and w <= words:
                    s = max(s, 0.85)
                if s > best[0]:
                    best = s, call, b
        archive = bool(years) and max(map(int, years)) <= YEAR - 2
        if best[0] >= 0.6:
            b = best[2]
            if share(words, b["title"][0]) >= 0.9 and a["issuer"] == b["issuer"] and (years, marks) == b["title"][1:3] and (years or marks or a["source"] == b["source"]):
                return best[1], "title", None
            return (a["id"], "new", None) if archive else (None, "doubt", best[1])
        if a["role"] and archive:
            return None, "ignore", None
        whole = len(words) >= 4 and re.search(titles.CALL_WORDS, plain(a["text"]))
        if a["role"] and not (a["role"] in ("extension", "amendment") and whole):
            return None, "doubt", None
        return a["id"], "new", None

    linked = []

    def first_with(test):
        """The call of the first linked announcement that passes."""
        return next((call for call, b in linked if test(b)), None)

    def add(a, call):
        calls.setdefault(call, []).append(a)
        linked.append((call, a))

    for *r, call in sorted(before, key=lambda r: (r[7], r[0])):
        add(item(r), call)
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        a = item(r)
        out[r[0]] = decide(a)
        if out[r[0]][0] is not None:
            add(a, out[r[0]][0])
    return out


SCHEMA = "id long, source string, issuer string, territory string, urls array<string>, code string, title string, seen long"
ISSUERS = ["camera modena", "camera bari", "camera foggia", "regione toscana", "comune siena", "provincia lucca", "ministero turismo", "", None]
THINGS = ["voucher digitali imprese", "contributi energia pulita", "fondo perduto GreenTour alberghi", "fiere estere mercati asiatici", "investimenti sostenibili 4.0", "borse studio ricerca giovani talenti"]


def titles_of(r, n):
    out = []
    for _ in range(n):
        thing = r.choice(THINGS)
        words = thing.split()
        if r.random() < 0.3:
            words[r.randrange(len(words))] = r.choice(("nuovi", "regionali", "Siena", "Modena", "turismo"))
        title = " ".join([r.choice(("Bando", "Avviso pubblico", "", "Bando per")), *words, r.choice(("", "", "2026", "2025", "2025/2026", "2022")), r.choice(("", "", "", "Linea A", "linea B", "secondo sportello", "edizione II", "n. 3", "misura 2.1", "3° call"))])
        if r.random() < 0.3:
            title = r.choice(("Proroga del ", "Graduatoria: ", "Rettifica ", "FAQ ", "Chiusura dello sportello ", "Decreto direttoriale 6 ottobre - proroga ", "Esiti ")) + title
        if r.random() < 0.2:
            title += r.choice((" Modena", " Siena", " Bari e Foggia", " Toscana"))
        out.append(re.sub(" +", " ", title).strip())
    return out


def announcements(seed, n):
    r = random.Random(seed)
    rows = []
    for i, title in enumerate(titles_of(r, n)):
        urls = r.sample([f"a.it/{k}" for k in range(n // 2)], r.choice((0, 0, 1, 1, 2)))
        code = r.choice([None] * 8 + [f"c{r.randrange(n // 8)}"])
        rows.append((i, f"s{r.randrange(5)}", r.choice(ISSUERS), r.choice(("LOM", "TOS", "ITA", "TN", "BZ", "TAA", "UE", None)), urls, code, title, r.randrange(n)))
    return rows


def linked(spark, rows, before=None):
    known = None if before is None else spark.createDataFrame(before, SCHEMA + ", call long")
    out = linking.link_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), known, YEAR).collect()
    assert len(out) == len(rows)
    return {x.id: (x.call, x.how, x.doubt) for x in out}


def test_title_parts(spark):
    r = random.Random(5)
    rows = [(t, r.choice(ISSUERS) or "") for t in titles_of(r, 200)] + [("", ""), ("Linea A e linea B, avviso n. 2 del 2024", "camera modena"), ("Prima edizione call 3 I bando", ""), ("Investimenti 4.0 Bando 2026", "")]
    got = spark.createDataFrame(rows, "title string, issuer string").select("title", "issuer", titles.title_parts(F.col("title"), F.col("issuer")).alias("p"), notices.role(F.col("title")).alias("role")).collect()
    for x in got:
        assert tuple(map(set, x.p)) == parse(x.title, x.issuer) and x.role == role_of(x.title), x


@pytest.mark.parametrize("seed", [1, 2])
def test_linking_equals_the_rules_in_order(spark, seed):
    rows = announcements(seed, 500)
    want = in_order(rows)
    assert linked(spark, rows) == want
    assert {how for _, how, _ in want.values()} == {"code", "url", "title", "new", "doubt", "ignore"}


def test_in_two_portions_and_again(spark):
    rows = sorted((r for r in announcements(3, 300)), key=lambda r: (r[7], r[0]))
    seen = set()
    # no address twice in one source: what is ambiguous must not change between the portions
    rows = [(*r[:4], [u for u in r[4] if not ((r[1], u) in seen or seen.add((r[1], u)))], *r[5:7], n) for n, r in enumerate(rows)]
    whole = linked(spark, rows)
    first = linked(spark, rows[:200])
    known = [(*r, first[r[0]][0]) for r in rows[:200] if first[r[0]][0] is not None]
    second = linked(spark, rows[200:], known)
    assert first | second == whole
    known += [(*r, second[r[0]][0]) for r in rows[200:] if second[r[0]][0] is not None]
    open_ = [r for r in rows if whole[r[0]][0] is None]
    again = linked(spark, open_, known)
    assert again == in_order(open_, known)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, None, None, 1), (2, "s", "x", "ITA", [None, "a.it/feed"], None, "", 1), (3, "s", "x", "ITA", [], None, "Proroga", None)]
    got = linked(spark, rows)
    assert got == {1: (1, "new", None), 2: (2, "new", None), 3: (None, "doubt", None)}
    assert linking.link_groups(spark.createDataFrame([], SCHEMA)).count() == 0
