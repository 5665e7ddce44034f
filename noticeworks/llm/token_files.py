"""Operator 11: token ids in binary files of independent zstandard frames with a trailing seek table.

A file is a run of frames, each compressed on its own, with ids of whole documents in ascending order of doc_id (a document
longer than a frame goes on in the next).  Behind them, in a skippable frame, lies the seek table: place, sizes and
XXH64 checksum of each frame and the documents it begins and ends with; behind that a footer of fixed size.  A reader
reads the footer, then the table, then only the frames that hold what it was asked for.  Any zstandard tool unpacks
the file too.

Texts are encoded in one pass, so only ids (half the size of their text, or less) are dealt into ranges of doc_id, each
sorted and written by one task.  The totals of the files, in order, give each its first id's place in the corpus.
"""

from __future__ import annotations

import array
import functools
import math
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeworks.llm.bpe import LATIN
from noticeworks.llm.common import fresh_path, shuffle_partitions, staged, table
from noticeworks.llm.warc import store

END_ID = 2
#: Ids of a frame and bytes of ids of a file, at which a new one is begun (a document may exceed a file, not a frame).
FRAME_IDS, FILE_BYTES = 1 << 16, 64 << 20
LEVEL = 3
#: Words of a generation, of which a worker remembers two (about 150 bytes a word), and characters of the longest of them.
CACHED_WORDS, LONGEST_WORD = 400_000, 64

# --- words to ids ------------------------------------------------------------------------------------------------

#: Latin letters whose lower case and composition are the same everywhere (no dotted capital I).
LETTERS = LATIN.replace("Ø-öø-ɏ", "Ø-öø-įı-ɏ")
PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{LETTERS}]*")
PLAIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")


class WordEncoder(dict):
    """A vocabulary of the tokenizers library; as a mapping, lower-case word -> its ids as little-endian unsigned 32-bit integers.

    Texts of Latin letters are split into words here and looked up, a word that is new is encoded by the library; all
    other texts, and those that may hold the vocabulary's special strings, go to the library whole.  When a generation of
    words is full it becomes the old one, from which words that come again are taken over, so frequent words stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def encode(self, text: str) -> bytes:
        ids = array.array("I", self.library.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, as the library gives them for the whole of it."""
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            raw = b"".join(map(self.__getitem__, PLAIN_WORDS.findall(text.lower())))
        else:
            raw = self.encode(text)
        return np.frombuffer(raw, "<u4")


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, raw (the ids of each whole text, null: empty, and then end_id) and width, the bytes of an id there."""
    end = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width = max(enc.width, 2 if end_id is None or end_id < 1 << 16 else 4)
        for batch in batches:
            n, raw = [], []
            for text in batch.column(1):
                ids = np.concatenate([enc.ids(text.as_py() or ""), end])
                n.append(len(ids))
                raw.append(ids.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array([width] * len(n), pa.int32())], names=["doc_id", "n_tokens", "raw", "width"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, raw binary, width int")


# --- the file format ---------------------------------------------------------------------------------------------

#: Fixed values of the format.  Of zstandard: the magic number of a skippable frame.  Of ours: the footer's last bytes.
SKIPPABLE, MAGIC = 0x184D2A5E, b"TOKF0001"
#: One piece of a document in a frame: has an id, id, place of its first id in the document, ids here, ids of the document.
PIECE_HEAD = struct.Struct("<BqQIQ")
#: One frame in the table: place, compressed and raw bytes, XXH64 of the raw bytes, pieces, ids, flags (first and last document have an id), first and last id.
ENTRY = struct.Struct("<QIIQIIBqq")
#: Frames, bytes of an id, CRC-32 of the table.
FOOTER = struct.Struct("<QBI8s")


class Piece(NamedTuple):
    """A run of a document's ids: doc_id, place of the first in the document, the document's number of ids, and the ids."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


class Frame(NamedTuple):
    at: int
    packed: int
    raw: int
    checksum: int
    pieces: int
    ids: int
    first: int | None
    last: int | None


class Writer:
    """Writes documents, in the order of their ids, to an open binary stream."""

    def __init__(self, out, width: int = 4):
        self.out, self.width, self.at, self.n_ids, self.n_docs = out, width, 0, 0, 0
        self.table: list[bytes] = []
        self.heads: list[tuple] = []
        self.bodies: list[bytes] = []
        self.held = 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """One document; raw: its ids in little-endian integers of the file's width."""
        total, start = len(raw) // self.width, 0
        while True:
            n = min(total - start, FRAME_IDS - self.held)
            self.heads.append((doc_id, start, n, total))
            self.bodies.append(raw[start * self.width : (start + n) * self.width])
            self.held, start = self.held + n, start + n
            if self.held >= FRAME_IDS or len(self.heads) >= FRAME_IDS:
                self.flush()
            if start >= total:
                break
        self.n_ids, self.n_docs = self.n_ids + total, self.n_docs + 1

    def flush(self) -> None:
        if not self.heads:
            return
        heads = b"".join(PIECE_HEAD.pack(d is not None, d or 0, start, n, total) for d, start, n, total in self.heads)
        body = heads + b"".join(self.bodies)
        packed = self.zip.compress(body)
        first, last = self.heads[0][0], self.heads[-1][0]
        known = (first is not None) + 2 * (last is not None)
        self.table.append(ENTRY.pack(self.at, len(packed), len(body), xxhash.xxh64_intdigest(body), len(self.heads), self.held, known, first or 0, last or 0))
        self.out.write(packed)
        self.at += len(packed)
        self.heads, self.bodies, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(self.table)
        tail = entries + FOOTER.pack(len(self.table), self.width, zlib.crc32(entries), MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(tail)) + tail)


class Reader:
    """Reads an open binary file that can seek: the table first, then frames as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.frames_read = file, 0
        file.seek(size - FOOTER.size)
        n, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        file.seek(size - FOOTER.size - n * ENTRY.size)
        entries = file.read(n * ENTRY.size)
        if zlib.crc32(entries) != crc:
            raise ValueError("the seek table is damaged")
        self.frames = [Frame(*e[:6], e[7] if e[6] & 1 else None, e[8] if e[6] & 2 else None) for e in ENTRY.iter_unpack(entries)]
        self.unzip = zstandard.ZstdDecompressor()

    def pieces(self, frame: Frame) -> Iterator[Piece]:
        """The documents, or parts of them, of one frame."""
        self.file.seek(frame.at)
        body = self.unzip.decompress(self.file.read(frame.packed), max_output_size=frame.raw)
        self.frames_read += 1
        if len(body) != frame.raw or xxhash.xxh64_intdigest(body) != frame.checksum:
            raise ValueError(f"the frame at {frame.at} is damaged")
        at = frame.pieces * PIECE_HEAD.size
        for has_id, doc_id, start, n, total in PIECE_HEAD.iter_unpack(memoryview(body)[:at]):
            yield Piece(doc_id if has_id else None, start, total, np.frombuffer(body, f"<u{self.width}", n, at))
            at += n * self.width

    def all(self) -> Iterator[Piece]:
        for frame in self.frames:
            yield from self.pieces(frame)

    def wanted(self, doc_ids: Iterable[int]) -> Iterator[Piece]:
        """The pieces of these documents, from the frames that can hold one."""
        asked = sorted(set(doc_ids))
        for frame in self.frames:
            if frame.last is None:
                continue
            at = np.searchsorted(asked, -(1 << 63) if frame.first is None else frame.first)
            if at < len(asked) and asked[at] <= frame.last:
                yield from (p for p in self.pieces(frame) if p.doc_id is not None and p.doc_id in asked)


# --- files of a corpus -------------------------------------------------------------------------------------------

#: A row a file.  first, hash, tie and number tell the files' order.
FILES = "name string, docs long, ids long, first long, last long, hash long, tie long, number long"
#: Rows of one id and text are told apart by so many numbers, so that very many of them need not be one task's.
TIES = 4096


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (doc_id, n_tokens, raw, width) in ascending order; returns a table of the files, in order, with start: ids of all files before.

    Null ids come first.  Rows of one id lie in the order of a hash of their ids, and may be in several ranges.  No rows
    give no files.
    """
    rows = rows.withColumns({"hash": F.xxhash64("raw"), "tie": F.pmod(F.monotonically_increasing_id(), F.lit(TIES))})
    rows = staged(rows, "tokens-encoded", compression="zstd")
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), "hash", "tie"]
    ranges = max(shuffle_partitions(rows.sparkSession), math.ceil(size / FILE_BYTES))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = store(folder)
        made, out, writer, held, first, last = [], None, None, 0, None, None

        def close() -> None:
            writer.close()
            out.close()
            made.append((name, writer.n_docs, writer.n_ids, first[0], last, *first[1:], len(made)))

        for batch in batches:
            for doc_id, width, hashed, tie, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                raw = raw.as_py()
                if writer is None:
                    disk.create_dir(base, recursive=True)
                    name, held, first = f"{uuid.uuid4().hex}.tokens.zst", 0, (doc_id, hashed, tie)
                    out = disk.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(out, width)
                writer.add(doc_id, raw)
                held, last = held + len(raw), doc_id
                if held >= FILE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if made:
            names = [f.split()[0] for f in FILES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "name" else pa.int64()) for n, c in zip(names, zip(*made), strict=True)], names=names)

    files = staged(dealt.select("doc_id", "width", "hash", "tie", "raw").mapInArrow(write, FILES), "tokens-files")
    before = Window.orderBy(F.col("first").asc_nulls_first(), "hash", "tie", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return staged(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "tokens-manifest", narrow=True)


def read_documents(files: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, frames_read of every document in files, or of doc_ids.

    start: ids of all documents before it.  ids_crc32: of the ids as little-endian unsigned 32-bit integers.  Given
    doc_ids, only files and frames that can hold one are read, and start is null.  Checksums are held against all
    that is read; damage is an error.  A document's pieces are taken in one by one, so none is held whole.
    """
    if doc_ids is not None:
        # one literal a document: a few documents at a time
        inside = [F.coalesce(F.col("first"), F.lit(-(1 << 63))).__le__(d) & (F.col("last") >= d) for d in doc_ids]
        files = files.filter(functools.reduce(lambda a, b: a | b, inside, F.lit(False)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = store(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, out, crc = f"{base}/{name}", [], 0
                with disk.open_input_file(path) as file:
                    reader = Reader(file, file.size())
                    for piece in reader.all() if doc_ids is None else reader.wanted(doc_ids):
                        crc = zlib.crc32(piece.ids.astype("<u4").tobytes(), crc if piece.start else 0)
                        if piece.start + len(piece.ids) == piece.doc_tokens:
                            out.append((piece.doc_id, start if doc_ids is None else None, piece.doc_tokens, crc, reader.frames_read))
                            start += piece.doc_tokens
                        if len(out) >= 10_000:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "frames_read"])

    files = files.select("name", "start").repartition(max(shuffle_partitions(files.sparkSession), 1), "name")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, frames_read long")


def write_corpus(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts (null: empty, so end_id alone), writes them in ascending order of id, and returns the table of files.

    Repeated rows are documents each; a null id comes before all others; other columns are not read; very long texts
    are cut at frames, never dropped; an empty table writes nothing.
    """
    return write_files(encoded(docs, vocabulary, end_id, id_col, text_col), folder)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    files = write_corpus(table(spark, sf_dir, "documents"), default_vocabulary(), folder)
    return read_documents(files, folder).drop("frames_read")


QUERIES = {"op11_token_files": op11_token_files}
ORACLE_SQL: dict[str, str] = {}
