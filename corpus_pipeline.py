"""Corpus preparation in five stages, each one operator of noticeworks.llm.

A stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns the columns of
documents, the last one packed pieces.  Stages read their inputs from Parquet, so none recomputes another.

In every stage null texts count as empty and stay null where texts are returned, repeated rows are judged each, very
long texts are read whole, further columns of documents are carried whatever their names, and no rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import near_dups, packing, passages, pii, quality
from noticeworks.llm.bpe import default_vocabulary
from noticeworks.llm.common import fresh_path, table


def same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def held(docs: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, text and, in one column of a name that no caller has, all columns but text: results of an operator cannot clash with them."""
    name = f"_row_{uuid.uuid4().hex}"
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias(name)), name


def released(out: DataFrame, name: str, docs: DataFrame) -> DataFrame:
    """The columns of docs: those that were held, and the text of out."""
    return out.select(*[F.col("text") if c == "text" else F.col(f"{name}.{c}").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rule ensemble, learned from this corpus' labels, scores below its cut."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows, name = held(docs)
    return released(quality.scored(rows, rules).filter("predicted = 1"), name, docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class."""
    return near_dups.keep_first(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes of 50-byte strings that an earlier document holds; a character cut in two goes, a null text stays null."""
    rows, name = held(docs)
    cut = passages.remove_repeats(rows, whole_characters=True)
    kept = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    return same_columns(released(cut.withColumn("text", kept), name, docs), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms."""
    return same_columns(pii.pseudonymised(docs, pii.DEMO_KEY), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of token ids."""
    return packing.pack_documents(docs, default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("passages", passage_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL has no BagMinHash, fitted rules or tokenizer; tests compare near duplicates and the operators with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows lie as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
