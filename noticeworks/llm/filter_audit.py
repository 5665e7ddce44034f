"""Operator 13: how the filters of a corpus act on each other, in every order, from one histogram of failure masks.

A native expression gives each document a bit for each filter that it fails.  The filter on repeated texts needs the
smallest doc_id of each text: texts are grouped by their SHA-256, so the group-by moves 32 bytes a document in place of
its text, and is combined before the shuffle, so a text that a third of all rows hold is one row a task.  Documents then
shrink to a histogram: a count, and the numbers of good and toxic documents, for each part and mask.  What any order of
filters keeps and removes at any step follows from these cells alone; documents are never looked at again.

With n filters a part has at most 2**n cells and n! orders of n steps.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.common import staged, table

#: White space between words; a word is a longest run of other characters.
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
REPEATED = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails each filter that looks at it alone: too short, repetitive, shouting, symbols."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.lit(100).cast("long") * distinct < F.lit(LEAST_DISTINCT).cast("long") * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS).cast("long") * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flags(labels: DataFrame) -> DataFrame:
    """label_id, good, toxic: one row for each labelled document, however often it is labelled."""
    return (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    )


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: the histogram.  Bit i of mask is the i-th filter; the last bit marks repeated texts.

    filters: conditions that are true where a document fails, by letter, over the columns of docs (by default those of
    ``text_filters``); null counts as passed.  part: by default the source, a null one being empty.  A null text counts
    as empty.  A text is repeated if a document with a smaller id has it; rows of one id are documents each, none
    repeated by the other, and rows without an id are neither repeated nor repeat others.  Labels without a document,
    null labels and repeated labels count for nothing more.  An empty table gives no cells.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    filters = filters or text_filters(text)
    part = F.coalesce((F.col("source") if part is None else part).cast("string"), F.lit(""))
    mask = sum((F.coalesce(f.cast("int"), F.lit(0)) * (1 << i) for i, f in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # rows without an id match no label; their digests deal them out all the same
    rows = rows.withColumn("spread", F.coalesce("doc_id", F.xxhash64("digest")))
    known = flags(labels)
    rows = rows.join(known, (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("label_id")), "left")
    key = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.select("doc_id", "spread", "digest", "part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    rows = rows.groupBy("doc_id", "spread", *key).agg(F.count("*").alias("n"))
    # of each text, a row for each part, mask and label it occurs with; the first id and how many rows have it
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first.alias("first"))
    texts = staged(texts, "audit-texts")
    smallest = texts.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"), F.count("*").alias("kinds")).filter("kinds > 1")
    texts = texts.join(smallest.drop("kinds"), "digest", "left")
    alone = F.col("unnamed") + F.when(F.col("first.doc_id") == F.coalesce("smallest", "first.doc_id"), F.col("first.n")).otherwise(0)
    alone, bit = F.coalesce(alone, F.lit(0)), 1 << len(filters)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), alone.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - alone).alias("n"))))
    rows = texts.select("part", "good", "toxic", split.alias("cell"))
    n = F.col("cell.n")
    return rows.groupBy("part", F.col("cell.mask").cast("int").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def orders(letters: str) -> Column:
    """An array of all steps of all orders: filter_order, step, the step's filter as a bit, and the filters before it as a mask."""
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    one_order = lambda order: [(order, i + 1, bit[x], sum(bit[y] for y in order[:i])) for i, x in enumerate(order)]
    steps = [step for order in itertools.permutations(letters) for step in one_order("".join(order))]
    text = ",".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'bit', {b}, 'before', {m})" for o, s, b, m in steps)
    return F.expr(f"array({text})")


def audited(histogram: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each step of each order.

    histogram: ``cells``; letters: the names of its bits, lowest first.  shapley adds up what a filter removes over all
    orders: a document that fails k filters is removed by each of them in one order of k.
    """
    size, total = 1 << len(letters), math.factorial(len(letters))
    at = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    parts = histogram.groupBy("part").agg(at.alias("at"))
    masks = F.array(*(F.lit(m) for m in range(size)))
    dense = lambda name: F.transform(masks, lambda m: F.coalesce(F.try_element_at("at", m)[name], F.lit(0).cast("long")))
    parts = parts.select("part", *(dense(name).alias(name) for name in ("n", "good", "toxic")))

    def survivors(name: str) -> Column:
        """For each set of filters, how many documents pass all of it."""
        passing = lambda s: F.aggregate(F.filter(masks, lambda m: m.bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda a, m: a + F.get(name, m))
        return F.transform(masks, passing)

    shares = F.array(*(sum((F.get("n", F.lit(m)) * (total // m.bit_count()) for m in range(size) if m >> i & 1), F.lit(0).cast("long")) for i in range(len(letters))))
    parts = parts.select("part", "n", shares.alias("shares"), *(survivors(name).alias(f"left_{name}") for name in ("n", "good", "toxic")))
    rows = parts.withColumn("s", F.explode(orders(letters)))
    before, after = F.col("s.before"), F.col("s.before").bitwiseOR(F.col("s.bit"))
    lost = lambda name: F.get(name, before) - F.get(name, after)
    removed, failing = lost("left_n"), F.get("left_n", F.lit(0)) - F.get("left_n", F.col("s.bit"))
    return rows.select(
        "part", "s.filter_order", "s.step", F.get("left_n", after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        F.get("n", F.col("s.bit")).alias("unique_fails"), lost("left_good").alias("good_lost"), lost("left_toxic").alias("toxic_lost"),
        F.get("shares", F.bit_count(F.col("s.bit") - 1)).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audited(staged(histogram, "audit-cells", narrow=True), "ABCD" + REPEATED)


ORACLE_SQL = {
    "op13_filter_audit": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), flagged AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), fails AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                   coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e
            FROM docs d LEFT JOIN flagged f ON d.doc_id = f.doc_id
        ), cells AS (
            SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
        ), letter AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(x, bit)
        ), orders AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
            FROM letter p, letter q, letter r, letter s, letter t
            WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31
        ), steps AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
            FROM orders, (SELECT unnest(range(1, 6)) AS step)
        ), rows AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM cells, steps GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM rows
    """
}
QUERIES = {"op13_filter_audit": op13_filter_audit}
