"""Operator 2: best-fit-decreasing packing of token ids into fixed windows.

Each task streams its split and packs it in blocks of a few million ids, so memory does not follow the split.  In
a block every document gives its full windows first; the remainders, longest first, each go to the tightest open
window that still holds them, found in a segment tree over remaining capacities.  Since documents may be cut, the
emptiest windows are at last taken apart to fill the gaps of the others: at most one window of a block stays short.

No shuffle: windows never cross blocks.  Ids of windows are (partition, block, number), so a task that runs again
on the same split gives the same rows.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.bpe import CHUNK, Encoder, default_vocabulary
from noticeworks.llm.common import release, table

WINDOW = 1024
#: Ids that a task packs at once: the tail of a block is its only padding, memory is about 40 bytes an id.
BLOCK_IDS = 4_000_000
#: Words of a generation, of which a worker remembers two (about 250 bytes a word).
CACHED_WORDS = 100_000
#: Pieces of one batch of results.
BATCH_PIECES = 20_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


class LibraryEncoder(Encoder):
    """The same word table, filled by the tiktoken library from the same vocabulary file.

    Operator 5 is about how words are encoded; packing and counting only need the ids, which a compiled library gives
    in a third of the time.  Both are the same ids, which tests hold against each other.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        tokens = {self.buffer[a:b].tobytes(): i for i, (a, b) in enumerate(zip(self.offsets, self.offsets[1:]))}
        for name in self.special:
            tokens.pop(name.encode(), None)
        letters = r"'(?:[stmd]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.library = tiktoken.Encoding("words", pat_str=letters, mergeable_ranks=tokens, special_tokens={})
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        """When a generation of words is full, those not met in the one behind it are forgotten."""
        ids = self.older.get(word)
        if ids is None:
            found = self.encode_word(word)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode_word(self, word: str) -> list[int]:
        easy = len(word) <= CHUNK and (word.isascii() or word.removeprefix(" ").isalpha())
        return self.library.encode_ordinary(word) if easy else super().encode_word(word)


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells the smallest capacity of at least so much."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.of: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.of[capacity].append(number)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need of an open window."""
        at, count = need + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, capacity: int) -> int:
        at = capacity + self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.of[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[list[tuple[int, int, int]]], dict[int, int]]:
    """Full windows of overlong documents, then the rests, longest first, each in the tightest window that holds it.

    Windows of pieces (document, start, length), and the capacity that is left in those that are not full of one document.
    """
    windows: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        full = n - n % window
        windows += [[(d, at, window)] for at in range(0, full, window)]
        if n > full:
            rest.append((n - full, d, full))
    tree = OpenWindows(window)
    left: dict[int, int] = {}
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        capacity = tree.tightest(n)
        if capacity is None:
            capacity, number = window, len(windows)
            windows.append([])
        else:
            number = tree.take(capacity)
        windows[number].append((d, start, n))
        left[number] = capacity - n
        if capacity > n:
            tree.add(capacity - n, number)
    return windows, left


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows, each a list of pieces (document, start, length), for documents of these lengths (all > 0)."""
    windows, left = best_fit(lengths, window)
    # fill gaps, fullest window first, from the emptiest one
    order = sorted((number for number in left if left[number]), key=lambda x: (left[x], x))
    i, j = 0, len(order) - 1
    while i < j:
        gap, donor = left[order[i]], windows[order[j]]
        while gap and donor:
            d, start, n = donor.pop()
            cut = min(gap, n)
            windows[order[i]].append((d, start + n - cut, cut))
            gap -= cut
            if n > cut:
                donor.append((d, start, n - cut))
        left[order[i]] = gap
        if not gap:
            i += 1
        if not donor:
            j -= 1
    return [w for w in windows if w]


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int | None = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: document, place in its ids, CRC-32 of the piece's ids, sequence and offset there.

    Each document is the ids of its whole text (null: empty) and then end_id.  Repeated rows are packed each on
    their own, a null id stays null, other columns are not read.  An empty table gives no rows.
    """
    if window < 1:
        raise ValueError("a window holds at least one id")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(vocabulary), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        ids: list[bytes] = []
        names: list[int | None] = []
        held = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            out = []
            batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=FIELDS)
            for pieces in pack([len(x) // 4 for x in ids], window):
                offset = 0
                for d, start, n in pieces:
                    crc = zlib.crc32(ids[d][4 * start : 4 * (start + n)])
                    out.append((names[d], start, n, crc, len(ids[d]) // 4, base + made, offset))
                    offset += n
                made += 1
                if len(out) >= BATCH_PIECES:
                    yield batch()
                    out.clear()
            if out:
                yield batch()
            ids.clear(), names.clear()
            held = 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.encode_bytes(text.as_py() or "") + end
                if raw:
                    ids.append(raw)
                    names.append(doc)
                    held += len(raw) // 4
                if held >= BLOCK_IDS:
                    yield from flush()
        yield from flush()
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
