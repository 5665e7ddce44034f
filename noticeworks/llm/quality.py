"""Operator 6: a quality classifier of sparse conjunctive rules over text statistics.

Statistics of each text are column expressions.  A forest of shallow trees is grown on a bounded sample of labelled
rows; every path from a root becomes a rule (a conjunction of thresholds), a logistic regression with an L1 penalty
keeps the few rules that matter, and these are compiled into one column expression: scoring is a projection over the
scan, without shuffle or Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.common import table

#: Labelled rows that are learned from at most, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTY = 0.002
CUT = 0.3

# Frequent words of English, German, French, Spanish and Italian.
COMMON = (
    "the of and to in a is that for it der die das und in zu den von ist mit le la les de et des un une est pour "
    "el los las y que en por con il lo di e che per non"
).split()

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, threshold) ...


def statistics(text: Column) -> dict[str, Column]:
    """Name -> statistic of a text that is not null; defined (0 or 1) for empty texts too."""
    chars = F.length(text)

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1))

    def share_of(one: str) -> Column:
        """The share of one character: how much shorter the text is without it."""
        return (chars - F.length(F.replace(text, F.lit(one), F.lit("")))) / F.greatest(chars, F.lit(1))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    in_words = F.length(F.array_join(words, ""))
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    return {
        "chars": F.log1p(chars),
        "words": F.log1p(F.size(words)),
        "lines_per_word": F.size(lines) / n_words,
        "word_length": in_words / n_words,
        "upper": share("[A-ZÀ-ÖØ-Þ]"),
        "digits": share("[0-9]"),
        "symbols": share(r"[#$%&*+=<>{}\[\]\\^~_@/]"),
        "bars": share_of("|"),
        "exclamations": share_of("!"),
        "periods": share_of("."),
        "commas": share_of(","),
        "spaces": (chars - in_words) / F.greatest(chars, F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n_words,
        "long_words": F.size(F.filter(words, lambda w: F.length(w) > 12)) / n_words,
        "common_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*COMMON))) / n_words,
        "ended_lines": F.size(F.filter(lines, lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*".!?:;"))) / n_lines,
        "capital_words": F.size(F.filter(words, lambda w: w.rlike("^[A-ZÀ-ÖØ-Þ]"))) / n_words,
    }


def with_statistics(docs: DataFrame, text_col: str, prefix: str = "__s_") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({prefix + k: v.cast("double") for k, v in statistics(text).items()})


def held_out(doc_id: Column) -> Column:
    """One fifth of all documents, by id; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def paths(tree: str, names: list[str]) -> set[Rule]:
    """All paths from the root in a tree's printed form."""
    found: set[Rule] = set()
    trail: list[tuple[int, tuple[str, bool, float]]] = []
    for line in tree.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        trail = [t for t in trail if t[0] < depth] + [(depth, (names[int(m[2])], m[3] == "<=", float(m[4])))]
        found.add(simplified([t[1] for t in trail]))
    return found


def simplified(terms: list[tuple[str, bool, float]]) -> Rule:
    """The tightest threshold for each statistic and side, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, most, at in terms:
        old = tight.get((name, most))
        tight[name, most] = at if old is None else min(old, at) if most else max(old, at)
    return tuple(sorted((name, most, at) for (name, most), at in tight.items()))


def holds(rule: Rule, prefix: str = "__s_") -> Column:
    terms = (F.col(prefix + name) <= at if most else F.col(prefix + name) > at for name, most, at in rule)
    return reduce(lambda a, b: a & b, terms)


class Rules:
    """An intercept and weighted rules; ``score`` is the compiled expression."""

    def __init__(self, intercept: float, weights: dict[Rule, float]):
        self.intercept, self.weights = intercept, weights

    def score(self, prefix: str = "__s_") -> Column:
        total = F.lit(self.intercept)
        for rule, w in self.weights.items():
            total = total + F.when(holds(rule, prefix), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Rules:
    """Learns from the labelled rows that are not held out, SAMPLE_ROWS of them at most.

    Null labels, ids and texts of unknown rows are left out; an id that is labelled twice counts with its smaller
    label.  Without rows of both classes the score is constant: the share of label 1 (1 if there is no label).
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = with_statistics(texts.join(F.broadcast(known), "id"), "text").drop("text")  # SAMPLE_ROWS rows of two numbers
    rows = rows.dropDuplicates(["id"]).coalesce(1).sortWithinPartitions("id").cache()
    try:
        count, ones = rows.agg(F.count("*"), F.sum("label")).first()
        if not count or ones in (0, count):
            share = 1.0 if not count else ones / count
            return Rules(50.0 if share == 1 else -50.0, {})
        names = [c.removeprefix("__s_") for c in rows.columns if c.startswith("__s_")]
        features = VectorAssembler(inputCols=[f"__s_{n}" for n in names], outputCol="features").transform(rows)
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7, featureSubsetStrategy="onethird"
        ).fit(features)
        rules = sorted(set().union(*(paths(t.toDebugString, names) for t in forest.trees)))
        return weighed(rows, rules)
    finally:
        rows.unpersist()


def weighed(rows: DataFrame, rules: list[Rule]) -> Rules:
    """Lasso logistic weights of the rules; those of weight 0 are gone."""
    fired = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("rules")).cache()
    try:
        model = LogisticRegression(
            labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False
        ).fit(fired)
    finally:
        fired.unpersist()
    return Rules(float(model.intercept), {r: float(w) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w})


def scored(docs: DataFrame, rules: Rules, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs and score (0 to 1) and predicted (0 or 1), which replace columns of these names; null texts score as empty."""
    out = with_statistics(docs.drop("score", "predicted"), text_col)
    out = out.withColumn("score", rules.score())
    return out.drop(*[c for c in out.columns if c.startswith("__s_")]).withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, rules).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
