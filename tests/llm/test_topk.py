"""Exact top-k: large components, empty and repeated vectors, clustered data whose bounds rule cells out, hot vectors."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import ball_trees, vectors

from .test_pii_quality_warc_topk import brute_top

SCHEMA = "vec_id long, embedding array<double>"


def exact(rows, k=5):
    clean = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    out = Counter()
    for q, a in {i: v for i, v in sorted(clean, key=lambda r: r[1], reverse=True) if i % 50 == 0}.items():
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q and len(b) == len(a))[:k]
        out.update((q, rank, i, -low) for rank, (low, i) in enumerate(hits, 1))
    return out


def test_large_components_are_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((-1, 1)) * r.uniform(1e5, 6e5) for _ in range(9)]) for i in range(150)] + [(200 + i, [3e5 + i % 3] * 9) for i in range(20)]
    rows += [(300, []), (301, []), (302, []), (350, [1.0]), (350, [2.0]), (350, [2.0]), (351, [0.5])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = vectors.top_k(frame, frame.filter("vec_id % 50 = 0")).collect()
    assert Counter(tuple(x) for x in got) == exact(rows)
    assert {tuple(x) for x in got if x.query_id == 300} == {(300, 1, 301, 0), (300, 2, 302, 0)}


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_waves_of_cells(spark, monkeypatch, spread):
    """Many small cells, hot equal vectors, few queries a part: the same as all pairs; tight clusters leave cells out."""
    for name, value in (("SHARD_ROWS", 60), ("CELL_ROWS", 20), ("BLOCK_QUERIES", 3), ("WAVES", (1, 3))):
        monkeypatch.setattr(ball_trees, name, value)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 8))
    points = centre[rng.integers(0, 12, 700)] + spread * rng.normal(size=(700, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("cell", F.lit("clash"))
    got = vectors.top_k(frame, frame.filter("vec_id % 50 = 0")).collect()
    assert Counter(tuple(x) for x in got) == brute_top(rows)
    clean = ball_trees.clean(frame, "vec_id", "embedding", 256)
    centres = ball_trees.centres_of(clean)
    assert 8 in centres and len(centres[8]) > 8
    if spread < 0.1:
        group = F.lit(0).cast("long").alias("grp")
        shards = ball_trees.Shards(ball_trees.with_cells(clean, centres).withColumn("grp", group), centres, 5)
        floors = spark.createDataFrame([(r.query_id, float(r.score)) for r in got if r.rank == 5], "query_id long, low double")
        asked = clean.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id").join(floors, "query_id")
        asked = asked.select("query_id", "dim", group, "v", "low", F.lit(None).cast("double").alias("high"), F.lit(False).alias("one_cell"))
        assert shards.promising(asked, 0, None).count() < 0.7 * asked.count() * len(shards.cells[8][0])
