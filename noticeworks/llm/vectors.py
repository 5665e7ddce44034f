"""Operator 4: exact top-k by inner product, ball-tree branch and bound per shard.

Cells, shards, trees and waves are those of ``ball_trees``, over all rows as one group.  A query (one of a stated set) visits
the cells whose bound ``q.centre + |q| radius`` reaches its k-th score so far, the most promising first; a cell of more rows
than a shard holds has sub-cells with bounds of their own.  Inside a shard nodes are visited in falling order of the same
bound, and the search ends once that is below the current k-th score, which waves share between shards.

A query's k-th score and candidates are exact whatever the sample was that cells are fitted on.  Equal vectors of a shard are
kept once with their smallest ids, so a vector that a third of all rows hold costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import ball_trees as trees
from noticeworks.llm.ball_trees import Shards, clean, highest
from noticeworks.llm.common import staged, table

K = 5


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by integer inner product, ties to smaller ids.

    Vectors that are null or hold a null or non-finite component take no part on either side; vectors of another
    dimension than the query's are no candidates (an empty vector's are the other empty ones, with score 0).  Rows of
    one id are candidates each; a query id that occurs twice is asked once, with its smallest vector.  Fewer than k
    candidates give fewer rows, an empty table none.  Components of any size give exact scores; a score among the best
    that does not fit 64 bits is an error.
    """
    group = F.lit(0).cast("long")
    rows = clean(vectors, id_col, vector_col, scale)
    asked = clean(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min_by(F.struct("dim", "v"), "v").alias("q"))
    asked = staged(asked.select(F.col("vec_id").alias("query_id"), "q.*", group.alias("grp"), F.lit(False).alias("one_cell")), "topk-queries")
    centres = trees.centres_of(rows)
    rows = staged(trees.with_cells(rows, centres), "topk-rows")
    best = highest(Shards(rows.withColumn("grp", group), centres, k), asked, k)
    hits = best.select("query_id", F.posexplode("best").alias("rank", "hit"))
    return hits.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.low")).cast("long").alias("score"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


ORACLE_SQL = {
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
}
QUERIES = {"op4_topk": op4_topk}
