"""Every stage on nulls, empty, repeated and long texts, columns that clash, and no rows; each against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from noticeworks.llm import bpe, pii, quality

from .conftest import corpus, prose
from .test_duplicates import brute_classes
from .test_pii_brute_force import brute as brute_pii
from .test_round_2 import plain_statistics

STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in ("score", "kept", "class_id", "found", "lang", "source", "bucket", "start")}).repartition(3, "text")


def as_bag(df):
    rows = df.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.score == "clash" == r.kept for r in rows)
    return Counter((r.doc_id, r.text) for r in rows)


def test_every_stage_on_odd_rows(spark, tmp_path, monkeypatch):
    rows = [*corpus(), (6, prose(6, 100)), (7, "card 4111 1111 1111 1111 " + prose(77, 20))]
    docs = frame(spark, rows)
    r = random.Random(1)
    labelled = [(i, prose(i, 40), 1) if r.random() < 0.6 else (i, " | ".join(prose(i, 40).split()), 0) for i in range(1000, 1300)]
    spark.createDataFrame([(i, q) for i, _, q in labelled] + [(None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    all_rows = [*rows, *((i, t) for i, t, _ in labelled)]
    out = STAGES["quality"](spark, frame(spark, all_rows), str(tmp_path))
    rules = quality.fit(frame(spark, all_rows), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = Counter()
    for d, t in all_rows:
        s = plain_statistics(t or "")
        total = rules.intercept + sum(w for rule, w in rules.weights.items() if all(s[n] <= at if most else s[n] > at for n, most, at in rule))
        if 1 / (1 + np.exp(-total)) >= quality.CUT:
            want[d, t] += 1
    assert as_bag(out) == want and 0 < sum(want.values()) < len(all_rows)

    classes = brute_classes(rows)
    assert as_bag(STAGES["near_dups"](spark, docs, "")) == Counter((d, t) for d, t in rows if d is None or classes[d] == d)

    got = STAGES["passages"](spark, docs, "")
    assert sorted(as_bag(got).elements(), key=str) == sorted(((d, None if t is None else _cut(rows, d, t)) for d, t in rows), key=str)

    monkeypatch.setattr(pii, "DEMO_KEY", "k2")
    assert as_bag(STAGES["pii"](spark, docs, "")) == Counter((d, brute_pii(t)[0]) for d, t in rows)

    library = Tokenizer.from_file(bpe.default_vocabulary())
    ids = Counter()
    for d, t in rows:
        x = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        ids[d, len(x), zlib.crc32(np.array(x[:1024], "<u4").tobytes()) if len(x) <= 1024 else None] += 1
    packed = STAGES["packing"](spark, docs, "").collect()
    assert sum(p.length for p in packed) == sum(n * k for (_, n, _), k in ids.items())
    whole = Counter((p.doc_id, p.doc_tokens, p.ids_crc32) for p in packed if p.start == 0 and p.length == p.doc_tokens)
    assert all(k in ids and whole[k] <= ids[k] for k in whole) and sum(whole.values()) > 20


def _cut(rows, doc_id, text):
    """The text without the characters that lose a byte to a document of a smaller id."""
    mine = text.encode()
    rank = lambda d: 1 << 63 if d is None else d
    earlier = {raw[i : i + 50] for d, t in rows if rank(d) < rank(doc_id) for raw in [(t or "").encode()] for i in range(len(raw) - 49)}
    gone = bytearray(len(mine))
    for i in range(len(mine) - 49):
        if mine[i : i + 50] in earlier:
            gone[i : i + 50] = b"\1" * 50
    at, out = 0, ""
    for c in text:
        n = len(c.encode())
        out += "" if any(gone[at : at + n]) else c
        at += n
    return out


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [(1, "x")]).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
