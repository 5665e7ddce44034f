"""Operator 9: token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes is reduced to one signed row a group; an entry in a log of numbered files, made last, makes it count.  An
entry is only made under a number that nobody has taken, and only by a writer that has seen all entries before it: of
two writers one has to look again, so a batch id counts once whoever sends it how often, and a batch is held against the
ledger as it is at its own place in the log.  A compaction names the last entry it has folded in; what others
commit meanwhile has higher numbers and stays live beside it.

Totals are the last compaction's totals and the deltas committed since: an insert adds, a delete subtracts, a revision does
both.  Changes that name their documents are also held against a ledger of signed counts a document: a delete or
revision of a document, or of a count, that is not there is refused and reported, with all changes of that document in
the batch.  Sums are combined before the shuffle, so a source with a third of all rows is one row a task.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.bpe import default_vocabulary
from noticeworks.llm.common import fresh_path, staged, table
from noticeworks.llm.packing import encoder

GROUP = ["source", "lang", "version"]
ENTRY = ["doc_id", *GROUP, "n_tokens"]
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long, attempt string"
LEDGER = "doc_id long, source string, lang string, version string, n_tokens long, sign long, attempt string"
#: An entry of the log: its number, a batch id or null for a compaction, the attempt whose rows count, the last entry folded in.
LOG = "number long, batch string, attempt string, upto long"


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of columns, null being equal to null."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a whole file at once, or gives False where there is one: a link on file systems, else a rename that does not replace (as HDFS has it)."""
    temporary = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        temporary, path = (urlsplit(x).path for x in (temporary, path))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(temporary, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(temporary), hadoop(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.exists(target) and files.rename(source, target):
        return True
    files.delete(source, False)
    return False


class Entry(NamedTuple):
    number: int
    batch: str | None
    attempt: str
    upto: int | None


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str, schema: str, form: str = "parquet") -> DataFrame:
        try:
            return self.spark.read.schema(schema).format(form).load(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> list[Entry]:
        """All entries, in order: one for each batch and compaction ever committed."""
        return sorted(Entry(*r) for r in self.read("log", LOG, "json").collect())

    def live(self, log: list[Entry]) -> DataFrame:
        """The attempts that count after these entries: the last compaction, and batches that it did not fold in."""
        last = max((e for e in log if e.batch is None), default=None)
        names = [e.attempt for e in log if e.batch is not None and (last is None or e.number > last.upto)]
        return self.spark.createDataFrame([(n,) for n in names + ([last.attempt] if last else [])], "attempt string")

    def counting(self, name: str, schema: str, log: list[Entry]) -> DataFrame:
        return self.read(name, schema).join(self.live(log), "attempt").drop("attempt")

    def commit(self, log: list[Entry], batch: str | None, attempt: str, upto: int | None = None) -> bool:
        """Whether the entry behind ``log`` was still free and is this one now."""
        number = log[-1].number + 1 if log else 1
        return put_if_absent(self.spark, f"{self.folder}/log/{number:012d}.json", json.dumps(Entry(number, batch, attempt, upto)._asdict()))

    def write(self, df: DataFrame, name: str, attempt: str) -> None:
        df.write.parquet(f"{self.folder}/{name}/attempt={attempt}")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits changes (sign, source, lang, version, n_tokens, perhaps doc_id) under a batch id; False if it had been committed.

        sign is +1 or -1; rows with a null sign or count change nothing; null sources, languages and versions are groups
        of their own; repeated rows count each.  Rows with a doc_id are held against the ledger, rows without are not.
        """
        known = "doc_id" in changes.columns
        rows = changes.filter("sign IS NOT NULL AND n_tokens IS NOT NULL")
        rows = rows.select((F.col("doc_id") if known else F.lit(None)).cast("long").alias("doc_id"), *GROUP, F.col("n_tokens").cast("long"), F.col("sign").cast("long").alias("sign"))
        takes = False
        if known:
            rows = staged(rows.groupBy(*ENTRY).agg(F.sum("sign").alias("sign")).filter("sign <> 0"), "token-changes", narrow=True)
            takes = rows.filter("doc_id IS NOT NULL AND sign < 0").limit(1).count() > 0
        attempt = None
        while True:
            log = self.log()
            if any(e.batch == batch for e in log):
                return False
            if attempt is None or takes:  # what takes nothing away is the same behind any entry
                attempt = uuid.uuid4().hex
                good = self.accepted(rows, attempt, log) if takes else rows
                if known:
                    self.write(good.filter("doc_id IS NOT NULL").select(*ENTRY, "sign"), "ledger", attempt)
                sums = good.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
                self.write(sums, "deltas", attempt)
            if self.commit(log, batch, attempt):
                return True

    def accepted(self, rows: DataFrame, attempt: str, log: list[Entry]) -> DataFrame:
        """Net changes without those of documents of which more would go than is there; these are written as refused."""
        minus = rows.filter("doc_id IS NOT NULL AND sign < 0")
        ledger = self.counting("ledger", LEDGER, log)
        have = ledger.join(minus, same(ledger, minus, ENTRY), "left_semi").groupBy(*ENTRY).agg(F.sum("sign").alias("have"))
        short = minus.join(have, same(minus, have, ENTRY), "left").filter(F.coalesce("have", F.lit(0)) + F.col("sign") < 0)
        short = staged(short.select(minus["doc_id"], minus["version"]).distinct(), "token-refused", narrow=True)
        on = same(rows, short, ["doc_id", "version"])
        self.write(rows.join(short, on, "left_semi").select(*ENTRY, "sign"), "refused", attempt)
        return rows.join(short, on, "left_anti")

    def refused(self) -> DataFrame:
        """doc_id, source, lang, version, n_tokens, sign of the net changes that did not fit what was there."""
        committed = self.spark.createDataFrame([(e.attempt,) for e in self.log()], "attempt string")
        return self.read("refused", LEDGER).join(committed, "attempt").drop("attempt")

    def documents(self, log: list[Entry] | None = None) -> DataFrame:
        """The ledger: how many documents of each id have which count."""
        return self.counting("ledger", LEDGER, self.log() if log is None else log).groupBy(*ENTRY).agg(F.sum("sign").alias("sign")).filter("sign <> 0")

    def totals(self, log: list[Entry] | None = None) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups whose documents are all deleted are left out."""
        deltas = self.counting("deltas", DELTAS, self.log() if log is None else log)
        sums = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Folds the deltas of all entries of one listing into an attempt, from which later totals go on; False with none.

        Batches stay committed; what is committed while this runs lies behind the last entry folded in and stays live.
        """
        log, attempt = self.log(), uuid.uuid4().hex
        if not log:
            return False
        self.write(self.totals(log), "deltas", attempt)
        self.write(self.documents(log), "ledger", attempt)
        upto = log[-1].number
        while not self.commit(log, None, attempt, upto):
            log = self.log()
        return True


def counted(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, and the number of ids of each whole text (null: 0), however long; repeated rows each, none of an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            n = [len(enc.encode_bytes(t.as_py() or "")) // 4 for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def signed(rows: DataFrame, sign: int, version: str, n_tokens=None) -> DataFrame:
    return rows.select(F.lit(sign).alias("sign"), "doc_id", "source", "lang", F.lit(version).alias("version"), (F.col("n_tokens") if n_tokens is None else n_tokens).alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two versions of a tokenizer, then, after a compaction, revisions and deletes; one batch is sent twice.

    Version 1 counts a text's ids, version 2 an end id besides.  A revision gives texts of over 1024 ids an end id for
    each further window in version 2; a delete takes texts without any id out of version 1.
    """
    rows = staged(counted(table(spark, sf_dir, "documents"), default_vocabulary()), "token-counts")
    rollup = Rollup(spark, fresh_path(spark, "token-rollup"))
    n = F.col("n_tokens")
    rollup.apply("insert-1", signed(rows, 1, "1"))
    rollup.apply("insert-2", signed(rows, 1, "2", n + 1))
    rollup.apply("insert-1", signed(rows, 1, "1"))
    rollup.compact()
    long = rows.filter(n > 1024)
    rollup.apply("revise-2", signed(long, -1, "2", n + 1).unionByName(signed(long, 1, "2", n + F.ceil(n / 1024))))
    rollup.apply("delete-1", signed(rows.filter(n == 0), -1, "1"))
    return rollup.totals()


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}
