"""Operator 8: WARC archives with revisit records, and their capture index by external k-way merge.

Writing: digests and ids alone tell the smallest page of each group of equal payloads, which becomes a response; the
others revisit it without payload.  Payloads stay where they are while the revisits fit a broadcast, else they are dealt by page,
never by digest.  Each task streams its rows into archives in the shared folder, one gzip member a record, and names
only the files that it finished; a task that runs again writes files of its own.

Reading: each archive is streamed back record by record and gives one run of captures, sorted by URL key and time.
The runs are dealt into ranges of (URL key, time, page, place), and each range merges its parts of all runs by a loser
tree, so that the ranges one after another are the global capture history.  The parts are held as they arrive, in
columns and in run order, and unfolded a few rows at a time.  Only the index moves, never payloads.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.common import fresh_path, shuffle_partitions, staged, table

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
#: Records and bytes of an archive, and captures in a range of the index.
ARCHIVE_RECORDS, ARCHIVE_BYTES, RANGE_ROWS = 50_000, 256 << 20, 200_000
#: Revisits that are broadcast at most (about 100 bytes each); parts of the rows of one digest without ids; rows of a run unfolded at once.
BROADCAST_REVISITS, SALTS, UNFOLDED = 200_000, 64, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Schemes of Spark's stores and what the same store is called here.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "abfss://": "abfs://", "wasbs://": "abfs://"}
CAPTURE = "url_key string, captured_at string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, position long"
CAPTURE_FIELDS = [part.split()[0] for part in CAPTURE.split(", ")]
CAPTURE_ARROW = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to", "position") else pa.string()) for n in CAPTURE_FIELDS])


def url_key(url: str | None) -> str:
    """Host from its end, then path and sorted query, lower case; empty without a URL."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return quote(url or "", safe=":/?&=,)(").lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + query if query else ''}".lower() if host else (parts.path or "").lower()


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    for scheme, name in SCHEMES.items():
        if folder.startswith(scheme):
            folder = name + folder[len(scheme) :]
    return fs.FileSystem.from_uri(folder)


def named_record(page_id: int | None, digest: str) -> str:
    """The record id of the response that others revisit, from what they know of it."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}"


def record(page_id: int | None, url: str | None, when: str, payload: bytes, digest: str, first: int | None, record_id: str | None = None) -> bytes:
    """One WARC record; a revisit of page ``first`` if that is given.  record_id: its own, by default that of a response that others revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first is not None else 'response'}", f"WARC-Record-ID: <{record_id or named_record(page_id, digest)}>"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Date: {when}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{named_record(first, digest)}>", f"Refers-To-Page-ID: {first}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[tuple[int, bytes]]:
    """The gzip members of a file, one at a time, with their places."""
    at, rest = 0, b""
    while True:
        unzip, parts, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            chunk = rest or stream.read(1 << 20)
            if not chunk:
                if used:
                    raise EOFError("an archive ends within a record")
                return
            parts.append(unzip.decompress(chunk))
            rest = unzip.unused_data
            used += len(chunk) - len(rest)
        yield at, b"".join(parts)
        at += used


def parsed(raw: bytes) -> tuple:
    """url_key, captured_at, page_id, record_type, payload_bytes, payload_digest, refers_to of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(fields["content-length"])
    if version != "WARC/1.1" or block[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    page = fields.get("page-id")
    digest, kind, refers = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], None
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of page {page} is damaged")
        length = len(payload)
    else:
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        refers = int(fields["refers-to-page-id"])
    return url_key(fields.get("warc-target-uri")), fields["warc-date"], int(page) if page else None, kind, length, digest, refers


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html, captured_at (ISO text) as archives below folder; returns their names, a row each.

    A null html counts as empty.  Of equal payloads of LEAST_BYTES or more, the smallest page_id is the response; rows
    that repeat that id are responses too, with one record id.  Rows without an id revisit a page that has one, else are
    responses.  An empty table gives no archives.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), "captured_at"
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    ids = rows.filter(F.octet_length("html") >= LEAST_BYTES).select("page_id", "digest")
    groups = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    # a page that revisits is told by page and digest; pages without an id by digest and salt, so that none is a hot key
    known = ids.filter("page_id IS NOT NULL").distinct().join(groups, "digest").select("page_id", F.lit(0).alias("salt"), "digest", "first")
    unknown = groups.select(F.lit(None).cast("long").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "digest", "first")
    if not ids.filter("page_id IS NULL").limit(1).count():
        unknown = unknown.limit(0)
    # the first page itself is there too: its response has the record id that the others name
    looked_up = staged(known.unionByName(unknown), "warc-revisits", narrow=True)
    if looked_up.count() <= BROADCAST_REVISITS:
        looked_up = F.broadcast(looked_up)
    r = looked_up.select(F.col("page_id").alias("r_page"), F.col("salt").alias("r_salt"), F.col("digest").alias("r_digest"), "first")
    salt = F.when(F.col("page_id").isNotNull(), 0).otherwise(F.pmod(F.xxhash64("url", F.spark_partition_id()), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("salt", salt)
    rows = rows.join(r, (rows.digest == r.r_digest) & rows.page_id.eqNullSafe(r.r_page) & (rows.salt == r.r_salt), "left")
    is_first = F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull()
    rows = rows.withColumns({"target": is_first, "first": F.when(~is_first, F.col("first"))})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = store(folder)
        out, name, n, size = None, "", 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, html, when, digest, first, target in zip(*(batch.column(c) for c in ("page_id", "url", "html", "captured_at", "digest", "first", "target")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    disk.create_dir(base, recursive=True)
                    out = disk.open_output_stream(f"{base}/{name}", compression=None)
                own = None if target.as_py() else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}/{n}')}"
                raw = record(page_id.as_py(), url.as_py(), when.as_py(), html.as_py().encode(), digest.as_py(), first.as_py(), own)
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = zipper.compress(raw) + zipper.flush()
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if n >= ARCHIVE_RECORDS or size >= ARCHIVE_BYTES:
                    yield from close()
                    out = None
        if out is not None:
            yield from close()

    return rows.select("page_id", "url", "html", "captured_at", "digest", "first", "target").mapInArrow(write, "archive string, records long")


def sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_runs(archives: DataFrame, folder: str) -> DataFrame:
    """The captures of every archive, each archive's as one sorted run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with disk.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    run = sorted(((*parsed(raw), name, at) for at, raw in members(stream)), key=sort_key)
                for at in range(0, len(run), 10_000):
                    part = run[at : at + 10_000]
                    columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), CAPTURE_ARROW.types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(at, at + len(part)), pa.int64())], names=[*CAPTURE_FIELDS, "rank"])

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(read, f"{CAPTURE}, rank long")


def unfolded(part: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a part of a run, a few at a time."""
    for at in range(0, len(part), UNFOLDED):
        yield from zip(*(c.to_pylist() for c in part.slice(at, UNFOLDED).columns), strict=True)


def parts_of_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where another run begins, or an earlier place of the same run."""
    if not len(batch):
        return
    run, rank = batch.column(7).dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column(9).to_numpy()
    cuts = [0, *(np.flatnonzero((run[1:] != run[:-1]) | (rank[1:] <= rank[:-1])) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a).select(CAPTURE_FIELDS)


def loser_tree_merge(runs: list) -> Iterator[tuple]:
    """Merges sorted runs: each inner node keeps the loser of its match, so a new head plays log2(k) matches."""
    k = len(runs)
    heads = [iter(r) for r in runs]
    done = (True,)
    now = [next(h, None) for h in heads]
    key = [done if r is None else (False, sort_key(r)) for r in now]
    losers = [-1] * k

    def play(i: int) -> int:
        """Takes run i up the tree; returns the winner.  A node that nobody has reached yet keeps i."""
        at = (i + k) // 2
        while at:
            other = losers[at]
            if other < 0:
                losers[at] = i
                return -1
            if (key[other], other) < (key[i], i):
                losers[at], i = i, other
            at //= 2
        return i

    winner = -1
    for i in range(k):
        winner = max(winner, play(i)) if k > 1 else i
    while k and now[winner] is not None:
        yield now[winner]
        now[winner] = next(heads[winner], None)
        key[winner] = done if now[winner] is None else (False, sort_key(now[winner]))
        winner = play(winner) if k > 1 else winner


def merged_history(runs: DataFrame) -> DataFrame:
    """All captures in order of (URL key, time, page) within and across part numbers: range_no, place, and the capture."""
    spark = runs.sparkSession
    parts = max(shuffle_partitions(spark), runs.count() // RANGE_ROWS + 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # columns as they come; every part is in order and so a run of its own
        parts = [unfolded(part) for batch in batches for part in parts_of_runs(batch)]
        out, place = [], 0
        for row in loser_tree_merge(parts):
            out.append((place, *row))
            place += 1
            if len(out) == 10_000:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    schema = pa.schema([("place", pa.int64()), *CAPTURE_ARROW])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # the place of a record is part of the key, so that no capture, however often repeated, is too much for one range
    ranges = runs.select(*CAPTURE_FIELDS, "rank").repartitionByRange(parts, "url_key", "captured_at", "page_id", "archive", "position")
    return ranges.mapInArrow(merge, f"place long, {CAPTURE}").withColumn("range_no", F.spark_partition_id())


def capture_history(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, captured_at) as archives, reads them back and merges their index.

    range_no, place, and CAPTURE.  Null, empty and repeated rows as in write_archives; an empty table gives no rows.
    """
    archives = staged(write_archives(pages, folder), "warc-archives")
    return merged_history(staged(read_runs(archives, folder), "warc-runs"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    when = F.date_format(F.timestamp_seconds(F.lit(int(start.timestamp())) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pages = table(spark, sf_dir, "pages").withColumn("captured_at", when)
    return capture_history(pages, fresh_path(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """
}
