"""Operator 7: threshold-scaled document sketches, in SQL expressions only.

A sketch keeps every five-word shingle hash below a threshold, a fixed fraction of the hash range, so its size follows
the document's, and the share of one sketch found in another estimates containment however unequal the two are.  A
document none of whose hashes lies below keeps its smallest one, which the threshold itself marks as a stand-in:
``merged`` unites sketches and drops stand-ins as soon as there is a kept hash, so the merge of the sketches of two sets of shingles
is the sketch of their union.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import shuffle_partitions, staged, table

SHINGLE = 5
#: One of so many hashes is kept.
SCALE = 8
#: Documents in an ordered bucket, and the most buckets (their bounds are all that the driver sees).
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536


def sketch(hashes: Column, scale: int = SCALE) -> Column:
    """The kept hashes, sorted."""
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < threshold(scale))))
    return F.when((F.size(kept) > 0) | (F.size(hashes) == 0), kept).otherwise(F.array(F.array_min(hashes)))


def threshold(scale: int = SCALE) -> Column:
    """Hashes below it are kept."""
    return F.lit(min(-(1 << 63) + (1 << 64) // scale, (1 << 63) - 1)).cast("long")


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two sets of shingles, from their sketches."""
    return sketch(F.array_union(a, b), scale)


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """Adds the sketch of a text column: all five-word shingles (lower case, split at white space), or one if shorter.

    Step by step, so that no expression is computed twice.
    """
    hashes = f"__hashes_{name}"
    words = f"__words_{name}"
    df = df.withColumn(words, F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    many = F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(SHINGLE)))
    )
    few = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(hashes, F.when(F.size(words) >= SHINGLE, many).otherwise(few))
    return df.withColumn(name, sketch(F.col(hashes), scale)).drop(words, hashes)


def as_text(kept: Column) -> Column:
    """16 hexadecimal digits a hash."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles (Jaccard), 0 to 1; two texts without words are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """doc_id, fingerprint: for joins and merges of sketches.  Null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_sketch(rows, "text", "kept", scale).select("doc_id", as_text(F.col("kept")).alias("fingerprint"))


def bucket_of(value: Column, heads: Column, lists: Column) -> Column:
    """How many of the sorted bounds are <= value; the bounds come as lists of equal length, with the first of each."""
    group = F.size(F.filter(heads, lambda h: h <= value))
    inside = F.size(F.filter(F.get(lists, group - 1), lambda x: x <= value))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * F.size(F.get(lists, F.lit(0))) + inside)


def ordered_bounds(ids: DataFrame) -> DataFrame:
    """One row: bounds of buckets of about BUCKET_ROWS ids each, as about sqrt(bounds) lists, and the first of each list.

    Stored, so that a task that runs again deals by the same bounds; at most MOST_BUCKETS numbers.
    """
    count = max(1, min(MOST_BUCKETS, math.ceil(ids.count() / BUCKET_ROWS)))
    cuts = [i / count for i in range(1, count)]
    numbers = sorted({int(x) for x in ids.approxQuantile("doc_id", cuts, 1 / (4 * count))}) if cuts else []
    bounds = ids.sparkSession.createDataFrame([(numbers,)], "bounds array<bigint>")
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("bounds"))).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("bounds") - 1)), lambda i: (i % F.col("step") == 0) & (i < F.size("bounds")))
    bounds = bounds.withColumn("step", step).withColumn("lists", F.transform(starts, lambda i: F.slice("bounds", i + 1, F.col("step"))))
    return staged(bounds.select(F.struct(F.transform("lists", lambda x: F.get(x, F.lit(0))).alias("heads"), "lists").alias("cut")), "fingerprint-bounds")


def with_next(rows: DataFrame, made) -> DataFrame:
    """made(rows) and next, a struct of what made gives the row with the next smaller doc_id; after the smallest, the largest.

    Rows (doc_id, not null, and text) are dealt to many ordered buckets of about equal size.  Each bucket also gets a
    copy of the first row of the bucket below, so one exchange of texts is enough and no bucket waits for another; what
    made adds is made behind the exchange, once a row.  Rows of one id lie in one bucket.
    """
    ids = rows.select("doc_id")
    cut = ordered_bounds(ids)

    def with_bucket(df: DataFrame) -> DataFrame:
        df = df.withColumn("cut", cut.select("cut").scalar())
        return df.withColumn("bucket", bucket_of(F.col("doc_id"), F.col("cut.heads"), F.col("cut.lists"))).drop("cut")

    # at most MOST_BUCKETS rows from here to the broadcast
    tops = with_bucket(ids).groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    down = Window.partitionBy(F.lit(0)).orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(down), F.first("bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select("doc_id", above.alias("bucket"))
    copies = rows.join(F.broadcast(tops), "doc_id").select(*rows.columns, "bucket")
    both = with_bucket(rows).withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    both = made(both.repartition(shuffle_partitions(rows.sparkSession), "bucket"))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc(), "text")
    carried = [c for c in both.columns if c not in ("bucket", "copy", "doc_id")]
    both = both.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter("NOT copy")
    return both.select("doc_id", *carried, *[F.col(f"next.{c}").alias(f"next_{c}") for c in carried])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document in
    falling order of id (after the last, the first).  Null texts count as empty.  Rows that share an id follow one
    another in the order of their texts.  Rows without an id have no next document: for them it is empty.
    contained_in_edited: the estimated share of a text's shingles that its edited text has.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketched = lambda df: with_sketch(df, "text", "kept", scale)
    placed = with_next(rows.filter("doc_id IS NOT NULL"), sketched)
    alone = sketched(rows.filter("doc_id IS NULL")).select("*", F.lit("").alias("next_text"), F.array().cast("array<bigint>").alias("next_kept"))
    rows = placed.unionByName(alone).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_kept", scale)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"),
        as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
        containment(F.col("kept"), F.col("edited_kept")).alias("contained_in_edited"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLE_SQL: dict[str, str] = {}
