"""Operator 12: hard negatives by branch and bound over sharded ball trees.

An anchor's positives are its best rows of the same label; its hard negatives are the best rows of other labels whose
score lies in a window below each positive's score.  Positives are searched in trees of their label, negatives in trees
of all rows.  Nodes bound inner products above and below: one is left out that lies outside every window, that is
strictly beneath what each window has found, or that holds the anchor's label alone.  Windows of one anchor share a visit.

Cells, shards, waves and blocks of queries are those of ``ball_trees``; a label of more rows than a shard holds is dealt to
cells, a smaller one is one shard, so neither a few hot labels nor very many small ones make a large or a tiny-tree task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import ball_trees as trees
from noticeworks.llm.ball_trees import Best, Shard, Shards, best_of, clean, fits, just_below, matrix, search
from noticeworks.llm.common import staged, table

POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def grouped_by_label(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with grp, their label, and cell only where the label has more rows than a shard; and those labels (dim, grp)."""
    large = rows.groupBy("dim", F.col("label").alias("grp")).count().filter(F.col("count") > trees.SHARD_ROWS).select("dim", "grp", F.lit(True).alias("large"))
    large = staged(large, "negatives-labels", narrow=True)
    rows = rows.withColumn("grp", F.col("label")).join(trees.small(large), ["dim", "grp"], "left")
    return rows.withColumn("cell", F.when(F.col("large"), F.col("cell")).otherwise(0)).drop("large"), large


def mined(
    vectors: DataFrame,
    anchors: str,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: rows with an id, a vector and a label (whole numbers).  anchors: a condition on vec_id.  Rows with a null
    id, label, vector or component, or a non-finite component, take no part; vectors of another dimension than the
    anchor's are no candidates.  Rows of one id are candidates each, for each other also positives and negatives each;
    an anchor's own id is neither, and an anchor id that occurs twice is asked once, with its smallest vector and label.
    Ties go to the smaller id.  Positives below zero have an empty window.  Fewer rows in a window give fewer results,
    an empty table none; components of any size give exact scores, of which one beyond 64 bits is an error.
    """
    rows = clean(vectors, id_col, vector_col, scale, label_col)
    asked = rows.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("v", "label", "dim")).alias("q"))
    asked = staged(asked.select(F.col("vec_id").alias("query_id"), "q.*"), "negatives-anchors")
    centres = trees.centres_of(rows)
    rows = staged(trees.with_cells(rows, centres), "negatives-rows")

    by_label, large = grouped_by_label(rows)
    one_cell = F.coalesce(~F.col("large"), F.lit(True)).alias("one_cell")
    own = asked.withColumn("grp", F.col("label")).join(trees.small(large), ["dim", "grp"], "left").select("query_id", "dim", "grp", "v", one_cell)
    best = trees.highest(Shards(by_label, centres, positives), own, positives)
    pairs = best.select(F.col("query_id"), F.explode("best").alias("hit")).select("query_id", F.col("hit.vec_id").alias("positive_id"), (-F.col("hit.low")).alias("positive"))
    pairs = staged(pairs.filter("positive >= 0"), "negatives-positives", narrow=True)

    windows = pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("positive")).alias("positives"))  # as many as positives at most
    asked = staged(asked.join(windows, "query_id").withColumns({"grp": F.lit(0).cast("long"), "one_cell": F.lit(False)}), "negatives-asked")
    found = in_windows(Shards(rows.withColumn("grp", F.lit(0).cast("long")), centres, negatives), asked, negatives, low, high)
    out = pairs.join(found, ["query_id", "positive"]).select("*", F.posexplode("best").alias("rank", "hit"))
    return out.select(
        F.col("query_id").alias("anchor_id"), "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("negative_id"),
        F.col("positive").alias("positive_score"), (-F.col("hit.low")).cast("long").alias("negative_score"),
    )


def in_windows(shards: Shards, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """query_id, positive and best: for each positive score the k best rows of other labels in its window."""

    def answer(shard: Shard, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        for query_id, query, label, scores, floors in zip(
            wanted["query_id"].tolist(), matrix(wanted["v"]), wanted["label"].tolist(), wanted["positives"], wanted["floors"], strict=True
        ):
            scores = [int(p) for p in scores]
            best = []
            for p, floor in zip(scores, floors, strict=True):
                bottom, top = window(p, low, high)
                best.append(Best(k, bottom if floor is None or math.isnan(floor) else max(bottom, floor), top))
            search(shard, query, query_id, best, label)
            out += [(query_id, p, -minus, score) for p, b in zip(scores, best, strict=True) for score, minus in b.heap]
        fits(score for *_, score in out)
        return pd.DataFrame(out, columns=["query_id", "positive", "vec_id", "score"])

    best, hundredth = None, F.lit(100.0)
    for first, last in shards.waves():
        if best is None:
            left = asked.withColumn("floors", F.transform("positives", lambda p: F.lit(None).cast("double")))
        else:
            floor = F.when(F.size("best") >= k, just_below(-F.element_at("best", -1)["low"]))
            known = best.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("positive", floor.alias("floor")))).alias("known"))
            left = asked.join(known, "query_id", "left").withColumn("floors", F.transform("positives", lambda p: F.try_element_at("known", p))).drop("known")
        # a little wider than the windows are: doubles
        least = lambda p, f: F.greatest(p.cast("double") * low / hundredth - 1 - F.abs(p.cast("double")) * 1e-12, f)  # noqa: E731  greatest leaves nulls out
        left = left.withColumns({
            "low": F.array_min(F.zip_with("positives", "floors", least)),
            "high": F.array_max(F.transform("positives", lambda p: p.cast("double") * high / hundredth + 1 + F.abs(p.cast("double")) * 1e-12)),
        })
        pairs = shards.promising(left.select("query_id", "dim", "grp", "v", "label", "positives", "floors", "one_cell", "low", "high"), first, last)
        found = shards.answered(pairs, answer, "query_id long, positive long, vec_id long, score long")
        if best is not None:
            so_far = best.select("query_id", "positive", F.explode("best").alias("hit")).select("query_id", "positive", "hit.vec_id", (-F.col("hit.low")).alias("score"))
            found = found.unionByName(so_far)
        best = staged(best_of(found, ["query_id", "positive"], k), "negatives-best")
    return best


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(noisy, "vec_id % 50 = 0")


ORACLE_SQL = {
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
                   CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
               n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM positives p JOIN pairs n USING (anchor_id)
        WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 3
    """
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
