"""What the findings of round 3 were about, case by case."""

import datetime as dt
import random

import duckdb

from noticeworks import catalogue
from noticeworks.llm import bpe, near_dups, packing


def answers(spark, tmp_path, name, **tables):
    """The rows of a query and those of its SQL over tables of a fixture, each given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    return sorted(map(tuple, got), key=str), sorted(want.fetchall(), key=str)


def test_source_health_parts_of_seconds(spark, tmp_path):
    """Half a second short of a day is no day, and keys below 0 or null have the last frequency."""
    times = [dt.datetime(2024, 1, 29, 0, 0, 0, 500000), dt.datetime(2024, 1, 29), dt.datetime(2023, 11, 1, 0, 0, 0, 1), dt.datetime(2023, 12, 31, 0, 0, 0, 1)]
    rows = [(i, f"TIMESTAMP '{ts}'", user) for i, (ts, user) in enumerate((ts, user) for ts in times for user in (1, 2, -1, -3, "NULL", 5 + times.index(ts)))]
    events = " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, {ts} AS ts, {user}::BIGINT AS user_id, 'purchase' AS event_type, 1.0::DOUBLE AS value" for i, ts, user in rows)
    got, want = answers(spark, tmp_path, "source_health", events=events)
    assert got == want and len(got) == 9


def test_doc_sufficiency_borders_of_words(spark, tmp_path):
    """A word beside a marked letter is one for the SQL."""
    texts = [(1, "ées the of and token = "), (2, "the of and token = és"), (3, "the of and token = est"), (4, "the of and token = _est este"), (5, "naïst und token = the of and"), (6, "is the of")]
    rows = [(d, s, text + " " + "x" * n) for d, text in texts for s, n in (("a", 3000 - d), ("b", 3000 + d), (f"c{d}", 3000))]
    documents = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, '{s}' AS source, '{t}' AS text" for i, (d, s, t) in enumerate(rows))
    got, want = answers(spark, tmp_path, "doc_sufficiency", documents=documents)
    assert got == want and len(got) == 8


def test_page_states_of_repeated_pages(spark, tmp_path):
    """A row each: text and html of a page come from its own row, not from a join of all rows of its number."""
    rows = [(1, "http://a.it/1", "<p>Bando chiuso</p>"), (1, "http://a.it/1", "<p>Bando aperto</p>"), (None, "http://a.it/2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(str(r.page_id) for r in catalogue.QUERIES["page_states"](spark, str(tmp_path)).collect()) == ["1", "1", "None"]


def test_link_changes_links_once(spark):
    """Its four counts read what was linked, not the pages again."""
    plan = catalogue.QUERIES["link_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "html" not in plan and "InPandas" not in plan


def test_components_of_few_edges(spark, monkeypatch):
    """One task joins few edges into the components that label passing finds."""
    rng = random.Random(3)
    edges = spark.createDataFrame([(a, b) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(60)) if a != b], "a long, b long")
    few = sorted(map(tuple, near_dups.components(edges).collect()))
    monkeypatch.setattr(near_dups, "SMALL_EDGES", -1)
    assert few == sorted(map(tuple, near_dups.components(edges).collect()))


def test_packing_remembers_few_words(monkeypatch):
    """Two generations of words at most, met ones kept, the same ids; no automaton for words of letters and ASCII."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    few, all_ = packing.LibraryEncoder(bpe.default_vocabulary()), bpe.Encoder(bpe.default_vocabulary())
    rng = random.Random(4)
    for _ in range(40):
        text = " ".join(["the été", *("".join(rng.choices("abéüñx1", k=rng.randrange(1, 9))) for _ in range(30))])
        assert few.encode_bytes(text) == all_.encode_bytes(text)
        assert len(few) <= 100 and len(few.older) <= 100 and ("the" in few or "the" in few.older)
    assert len(all_) > 300 and "automaton" not in vars(few)
    odd = "l’été – «où» 日本語 \u00a0 ½ x̂"
    assert few.encode_bytes(odd) == all_.encode_bytes(odd) and "automaton" in vars(few)
