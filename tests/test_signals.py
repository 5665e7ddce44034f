import datetime as dt
import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import signals
from noticeworks.operators import cards

from .test_operators import column

TODAY = dt.date(2026, 10, 1)


@pytest.mark.parametrize("text, published, closed, opened", [
    ("Misura in vigore dal 1/1/2026 al 31/8/2026", None, ["period over"], []), ("in vigore dal 1/1/2026 al 31/12/2026", None, [], ["in force"]),
    ("in vigore dal 1/1/2025 al 31/8/2025", dt.date(2026, 1, 1), [], ["period over"]), ("Scadenza: 10/11/2026", None, [], ["deadline ahead"]), ("scadenza 10/11/2020", None, [], []),
    ("domande entro le ore 13.00 del 12 ottobre 2026", None, [], ["term ahead"]), ("spese da rendicontare entro il 12 ottobre 2026", None, [], []),
    ("Stato: chiuso", None, ["state word"], []), ("bilancio non sia ancora stato chiuso", None, [], []), ("bando aperto", None, [], ["state word"]), ("bando sospeso", None, [], []),
    ("Valutazione Data aggiornamento stato 16/07/2026", None, ["state label"], []), ("Chiuso data aggiornamento stato: 16/07/2025", dt.date(2026, 1, 1), [], ["state label"]),
    ("si comunica la chiusura anticipata dello sportello", None, ["closed early"], []), ("salvo chiusura anticipata", None, [], []), ("risorse esaurite. Riapertura a breve", None, [], []),
    ("altri strumenti non più operativi", None, [], []), ("fino a esaurimento delle risorse", None, [], []), ("x" * 2500 + " bando chiuso", None, [], []), (None, None, [], []),
])
def test_signals(text, published, closed, opened):
    assert signals.signals_of(text, TODAY, published) == (closed, opened)


def test_struck_dates():
    one = lambda html: signals.struck_dates_of(html, TODAY)
    assert one("<p>entro il <s>4/09/2026</s> 18/09/2026</p>") == ["2026-09-18"]
    assert one("<p>dal 7/08/2026 al <del>4/09/2026</del> 18/12/2026</p>") == [] and one("<p><s>4/09/2026</s></p><p>18/09/2026</p>") == []
    assert one('<td><span style="text-decoration: line-through">1 settembre 2026</span> ora 5 settembre 2026</td>') == ["2026-09-05"] and one(None) == [] and one("<s>x</s> 1/1/2020") == []


def test_state_and_phrases(spark):
    rows = spark.createDataFrame([(["a"], []), ([], ["b"]), (["a"], ["b"]), ([], []), (None, None)], "c array<string>, o array<string>")
    assert [r.s for r in rows.select(signals.fused_state(F.col("c"), F.col("o")).alias("s")).collect()] == ["closed", "open", None, None, None]
    new = "La  piattaforma è chiusa\nBando chiuso\nLo sportello potrà essere sospeso"
    pair = spark.createDataFrame([("bando  chiuso\nx", new), (None, None)], "a string, b string")
    assert [r.p for r in pair.select(signals.closing_phrases(F.col("a"), F.col("b")).alias("p")).collect()] == [["piattaforma è chiusa"], []]
    page = spark.createDataFrame([("bando contributo domanda", 0, False), ("accedi con spid", 0, False), ("x" * 500, 0, False), ("x", 0, False), ("", 4, True), ("bando", 1, True), (None, 0, False)], "t string, d int, p boolean")
    got = [r.v for r in page.select(signals.official_page(F.rpad("t", F.when(F.col("d") == 0, F.greatest(F.length("t"), F.when(F.col("t").startswith("b"), 420).otherwise(1))).otherwise(F.length("t")), " "), F.col("d"), F.col("p")).alias("v")).collect()]
    assert got == ["call", "login", "no sign", "empty", "call", "login", "empty"]


def test_categories(spark):
    act = "Art. 1 beneficiari e spese ammissibili, dotazione finanziaria " + "x" * 3000
    rows = [("Avviso Asse II Allegato B", "", "pdf", act, "bando"), ("Allegato B", "", "pdf", act, "altro"), ("Allegato B", "", "pdf", "il sottoscritto " + act, "modulistica"), ("DD n. 331 Proroga", "modulistica.pdf", "pdf", None, "decreto"), ("x", "", "pagina", None, "pagina"), (None, "FAQ.pdf", "pdf", None, "faq")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, f string, k string, t string, w string")
    assert [(r.c, r.w) for r in df.select("i", "w", signals.document_category(F.col("n"), F.col("f"), F.col("k"), F.col("t")).alias("c")).orderBy("i").collect()] == [(r[4], r[4]) for r in rows]
    assert column(spark, ["Decreto 5-3-2026", "del 2024 e 2025", "x"], signals.date_in_name) == ["20260305", "20250000", "00000000"]


def test_sections():
    text = "Menu\nAvviso: codice 423 prorogato\nBando export cod. 555\nlink\nBando fiere cod. 423\nlink\nlink\nBando export cod. 555\nlink"
    mine, other = signals.signature("Bando fiere (cod. 423)", None, []), signals.signature("x", "555", [])
    assert signals.section_of(text, [i for i in range(len(text)) if text.startswith("link", i)], mine, [other]) == "Bando fiere cod. 423 link link"
    assert signals.signature("Bando voucher digitali imprese", None, ["Bando voucher turismo"]) == "digitali" and signals.signature("Bando per il 2026", None, []) is None
    assert re.search(signals.signature("Fiere estere Asia", None, []), "le fiere (in paesi) estere", re.I) and signals.section_of("abc", [], "zzz", []) is None


def test_recipients(spark):
    cases = [
        (("si", None, None, ["ente_terzo_settore"]), ["imprese", "non_profit"]), (("incerto", None, None, None), ["da_determinare"]), (("no", "enti di formazione", None, None), ["da_determinare"]),
        (("no", "è una gara d'appalto", None, None), []), (("no", "non possono partecipare le associazioni", None, None), ["da_determinare"]), (("no", "per associazioni e comuni", None, None), ["non_profit", "enti_pubblici"]),
        (("no", "altro", "rivolto a studenti", None), ["persone_fisiche"]), (("no", "per i cittadini", "scuole", None), ["persone_fisiche"]), (("no", None, None, ["ente_pubblico"]), ["enti_pubblici"]), (("no", None, None, None), ["da_determinare"]),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, p string, m string, w string, s array<string>")
    out = df.select("i", signals.recipients(F.col("p"), F.col("m"), F.col("w"), F.col("s")).alias("r")).orderBy("i").collect()
    assert [r.r for r in out] == [w for _, w in cases]


CARD = "kinds array<string>, kind string, base_percent double, percent double, percent_grant double, grant_max double, contribution_max double, loan_max double, loan_percent double, by_size map<string,double>, lines array<struct<name:string,kinds:array<string>,percent:double,grant_max:double,contribution_max:double>>"


@pytest.mark.parametrize("card, want", [
    ((["finanziamento_agevolato", "fondo_perduto"], None, None, 30.0, None, None, 50000.0, None, 70.0, None, None), [("Tutti i beneficiari", "fondo perduto 30% (fino a 50.000 €) + finanziamento agevolato 70%")]),
    ((None, "voucher", 12.5, 30.0, None, None, 0.0, None, None, None, None), [("Tutti i beneficiari", "voucher 12,5% (fino a 0 €)")]),
    ((["fondo_perduto"], None, None, None, None, 1e6, None, None, None, {"grande": 20.0, "micro": 50.0}, None), [("Micro imprese", "fondo perduto 50% (fino a 1.000.000 €)"), ("Grandi imprese", "fondo perduto 20% (fino a 1.000.000 €)")]),
    ((["fondo_perduto"], None, None, 40.0, None, None, 9.0, None, None, {"micro": 50.0}, [("A", None, 60.0, None, None), (None, ["premio"], None, None, 5.0), ("C", None, None, None, None)]), [("A", "fondo perduto 60% (fino a 9 €)"), ("Linea", "premio 40% (fino a 5 €)")]),
    (([], None, None, None, None, None, None, None, None, None, None), None),
])
def test_incentive_rows(spark, card, want):
    df = spark.createDataFrame([card], CARD).withColumn("rows", cards.incentive_rows())
    r = df.select(F.transform("rows", lambda x: F.struct(x["for_whom"], cards.described(x).alias("d"))).alias("r")).first().r
    assert (None if r is None else [tuple(x) for x in r]) == want


def test_persisted_links(spark):
    announcements = spark.createDataFrame([(1, None, False, "a"), (2, 20, True, "b"), (3, 30, False, "c"), (4, None, False, "d"), (5, None, False, "e"), (6, 60, False, "f")], "id long, call_id long, by_hand boolean, title string")
    linked = spark.createDataFrame([(1, 1, "new", None), (4, 1, "title", None), (2, 2, "new", None), (3, 2, "url", None), (5, 5, "new", 1)], "id long, call long, how string, doubt long")
    calls = spark.createDataFrame([(20, False), (30, False), (60, False), (70, True), (80, False)], "call_id long, kept boolean")
    out = {k: sorted(tuple(r) for r in v.collect()) for k, v in cards.persisted(announcements, linked, calls).items()}
    assert out == {"calls": [(1, "a", 2)], "links": [(1, 1, "new"), (3, 20, "url"), (4, 1, "title")], "doubts": [(5, 1)], "orphans": [(30,), (80,)]}


def test_found_elsewhere(spark):
    r = random.Random(1)
    words = [f"parola{i}" for i in range(12)]
    title = lambda: " ".join(r.sample(words, 5))
    lost = [(i, f"http://x/{i}" if i % 3 else None, title()) for i in range(15)] + [(99, None, None)]
    known = [(100 + i, f"http://www.x/{i}/" if i % 4 == 0 else None, title()) for i in range(25)]
    got = {x.id: (x.found, x.how) for x in cards.found_elsewhere(*(spark.createDataFrame(d, "id long, url string, title string") for d in (lost, known)), 0.6).collect()}
    for i, url, t in lost:
        same = [k for k, u, _ in known if url and u and u.replace("www.", "").rstrip("/") == url]
        scores = [(difflib.SequenceMatcher(None, t or "", k[2]).ratio(), -k[0]) for k in known if set((t or "").split()) & set(k[2].split())]
        best = max(scores, default=(0, 0))
        assert got[i] == ((min(same), "address") if same else (-best[1], "title") if best[0] >= 0.6 else (None, None))


def test_applied_once_for_good(spark, tmp_path):
    from noticeworks.streaming import visits

    write = visits.once_writer(f"{tmp_path}/ledger")
    frame = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "event_id long, v string")
    write(frame(1, 2, 2), 0)
    write(frame(2, 3), 1)
    write(frame(2, 3), 1)
    write(frame(1, 2, 2), 0)
    assert sorted((r.event_id, r.batch) for r in spark.read.parquet(f"{tmp_path}/ledger").collect()) == [(1, 0), (2, 0), (3, 1)]


def test_queues_and_job_states(spark):
    from noticeworks.operators import health

    now = dt.datetime(2026, 1, 31)
    ago = lambda **k: now - dt.timedelta(**k)
    runs = spark.createDataFrame([("a", 1, ago(hours=1), ago(minutes=50), True), ("b", 1, ago(hours=5), None, None), ("c", 1, ago(hours=30), ago(hours=29), True), ("d", 1, ago(minutes=5), ago(minutes=4), False)], "job string, run_id int, started_at timestamp, ended_at timestamp, ok boolean")
    jobs = spark.createDataFrame([(j, 3600 * 4) for j in "abcde"], "job string, every_seconds int")
    assert {r.job: r.status for r in health.job_status(runs, jobs, F.lit(now)).collect()} == {"a": "done", "b": "interrupted", "c": "late", "d": "failed", "e": "never"}
    sources = spark.createDataFrame([(s, "weekly") for s in "abcd"], "source_id string, frequency string")
    checks = spark.createDataFrame([("a", ago(days=8), "ok"), ("b", ago(days=2), "ok"), ("c", ago(hours=5), "error"), ("c", ago(days=30), "ok")], "source_id string, started_at timestamp, outcome string")
    assert sorted(r.source_id for r in health.due_backlog(sources, checks, F.lit(now)).collect()) == ["a", "d"]
