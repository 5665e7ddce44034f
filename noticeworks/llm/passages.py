"""Operator 10: repeated passages removed, by blockwise suffix sorting with cover-sample ranks.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  That is a
question about suffixes cut at ``length`` bytes; sorting all of them would move many times the input.  So only a
*cover sample* of suffixes is sorted: positions chosen so that any two equal strings of ``length`` bytes hold a
sampled position at the same place.  A fixed residue cover modulo v needs about 1/sqrt(v) of all positions (18 % at
v = 31); here the cover is chosen by content - in each window the position of the smallest hashed gram - which has
the same property with 2 / (length - gram + 2) of them (7 %).

1. Documents are gathered, as they lie, into blocks of a few MB (written once, compressed).
2. Each block sends the distinct hashes of its sampled grams to buckets; a bucket tells which occur in two blocks, and
   which are *hot*, that is, sampled at very many places.
3. Each block sends the suffixes sampled at such grams, with what stands ``length - gram`` bytes before them, once
   for each distinct context with its smallest document.  One suffix bucket at a time is sorted: forward contexts
   and backward contexts give ranks with common-prefix lengths, and a window that starts d bytes before a sampled
   position is named by the pair of ranks cut at (length - d, d): ties of any length need no further text.
   The smallest document of each name decides.
4. The verdicts go back to the blocks, where documents lose the covered bytes.

A block sends a context once however often it holds it.  Contexts within a common passage are equal everywhere, but
those at its first and last samples also hold what stands around it, another text in each document, under one gram.
Hot grams therefore send no contexts but their windows, each once a block with its smallest document, dealt by their
own text: what differs is spread over all buckets, and what is equal weighs in a bucket no more than the number of
blocks.  Nothing is capped or sampled away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks.llm.common import release, shuffle_partitions, staged, table

LENGTH = 50
#: Bytes of text in a block, in a stretch that is looked at at once, and behind a bucket.
BLOCK_BYTES = 2 << 20
STRETCH = 1 << 20
BUCKET_BYTES = 64 << 20
#: Places at which a gram is sampled before its windows are dealt one by one.  A block tells how often it holds a gram
#: only from MANY on, so at most MANY times as many places can meet.
HOT, MANY = 16_384, 8
RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def gram_of(length: int) -> int:
    return max(1, length // 2 - 1)


# --- blocks ---------------------------------------------------------------------------------------------------


def packed(table_: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table_)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def to_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in the order in which they come, a few MB at a time; texts are column 1."""
    base, number, held, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0, [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([base + number], pa.int64()), "size": pa.array([size], pa.int64()), "data": pa.array([packed(pa.Table.from_batches(held))], pa.binary())}
        )

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if len(batch) else []
        at = 0
        while at < len(batch):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + block_bytes - size, "right")))
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1] - done)
            at = end
            if size >= block_bytes or end < len(batch):
                yield block()
                number, held, size = number + 1, [], 0
    if held:
        yield block()
    held = []
    release()


class Block:
    """The texts of a block as one run of bytes; text i is bytes[at[i]:at[i + 1]]."""

    def __init__(self, raw: bytes):
        self.rows = unpacked(raw)
        ids = self.rows.column(0)
        ids = pc.fill_null(ids.cast(pa.int64()), np.iinfo(np.int64).max)  # an unknown id counts as the largest
        self.ids = ids.to_numpy(zero_copy_only=False) if len(self.rows) else np.zeros(0, np.int64)
        text = pc.fill_null(self.rows.column(1).cast(pa.large_binary()), b"").combine_chunks()
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        self.bytes = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]

    def document(self, where: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, where, "right") - 1


# --- the cover sample -----------------------------------------------------------------------------------------

BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each place, by doubling."""
    one = (data.astype(np.uint64) + np.uint64(1)) * SPREAD
    have, power, size = one, BASE, 1
    out, out_size = None, 0
    left = gram
    while True:
        if left & 1:
            if out is None:
                out, out_size = have, size
            else:  # have covers what comes first, out what follows
                n = len(data) - (out_size + size) + 1
                lift = np.uint64(pow(int(BASE), out_size, 1 << 64))
                out, out_size = have[:n] * lift + out[size : size + n], out_size + size
        left >>= 1
        if not left:
            break
        n = len(have) - size
        have, power, size = have[:n] * power + have[size:], np.uint64(pow(int(power), 2, 1 << 64)), 2 * size
    out = out ^ (out >> np.uint64(31))
    out = out * SPREAD
    return out ^ (out >> np.uint64(29))


class Sample:
    """The sampled positions of a block: anchor, the windows that it stands for and its gram's hash (48 bits)."""

    def __init__(self, block: Block, length: int, stretch: int = STRETCH):
        gram = gram_of(length)
        width = length - gram + 1
        parts: list[tuple[np.ndarray, ...]] = []
        total, low = len(block.bytes), np.uint64((1 << 24) - 1)
        for start in range(0, max(0, total - length + 1), stretch):
            stop = min(total, start + stretch + length - 1)
            hashes = gram_hashes(block.bytes[start:stop], gram)
            best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
            size = 1
            while 2 * size <= width:
                best = np.minimum(best[:-size], best[size:])
                size *= 2
            if width > size:
                best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
            anchor = (best & low).astype(np.int64)
            first = np.arange(start, start + len(anchor))
            inside = first + length <= block.at[block.document(first) + 1]
            first, anchor = first[inside], anchor[inside]
            if len(first):
                new = np.flatnonzero(np.r_[True, (np.diff(first) != 1) | (np.diff(anchor) != 0)])
                count = np.diff(np.r_[new, len(first)])
                parts.append((anchor[new] + start, first[new], count, hashes[anchor[new]] >> np.uint64(16)))
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        self.anchor, self.first, self.count, self.hash = (np.concatenate(c) for c in zip(*parts)) if parts else empty
        self.doc = block.document(self.first)


def contexts(block: Block, sample: Sample, pick: np.ndarray, length: int) -> np.ndarray:
    """For the picked positions: the bytes from length - gram before to length after, others than their windows' 0,
    and then how far the first and last window begin before it."""
    reach = length - gram_of(length)
    anchor, first, count = sample.anchor[pick], sample.first[pick], sample.count[pick]
    out = np.zeros((len(pick), reach + length + 2), np.uint8)
    where = anchor[:, None] + np.arange(-reach, length)
    mine = (where >= first[:, None]) & (where < (first + count - 1 + length)[:, None])
    out[:, :-2] = np.where(mine, block.bytes[np.clip(where, 0, len(block.bytes) - 1)], 0)
    out[:, -2] = anchor - first
    out[:, -1] = anchor - first - count + 1
    return out


class Classes:
    """Equal contexts of a block's picked positions; the smallest document of each, first place first, stands for it."""

    def __init__(self, block: Block, sample: Sample, pick: np.ndarray, length: int):
        rows = contexts(block, sample, pick, length)
        ids = block.ids[sample.doc[pick]]
        words = big_words(rows)
        order = np.lexsort((sample.first[pick], ids, *words.T[::-1])) if len(pick) else np.zeros(0, np.int64)
        sorted_words = words[order]
        new = np.r_[True, (sorted_words[1:] != sorted_words[:-1]).any(1)] if len(pick) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        self.of = np.empty(len(pick), np.int64)
        self.of[order] = number
        self.head = order[new]
        self.rows, self.ids = rows, ids
        self.later = ids > ids[self.head][self.of] if len(pick) else np.zeros(0, bool)


class Windows:
    """Equal windows of the picked positions; the smallest document of each, first place first, stands for it."""

    def __init__(self, block: Block, sample: Sample, pick: np.ndarray, length: int):
        count = sample.count[pick]
        self.owner = np.repeat(np.arange(len(pick)), count)
        start = sample.first[pick][self.owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.depth = sample.anchor[pick][self.owner] - start
        rows = np.lib.stride_tricks.sliding_window_view(block.bytes, length)[start] if len(start) else np.zeros((0, length), np.uint8)
        ids = block.ids[sample.doc[pick]][self.owner]
        smallest, self.of = smallest_of_equal(rows, ids, start)
        self.later = ids > ids[smallest][self.of]
        self.start, self.ids, self.rows = start[smallest], ids[smallest], rows[smallest]


def smallest_of_equal(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each class of equal rows the place of the one with the smallest keys; and the class of each row."""
    words = big_words(rows)
    order = np.lexsort((*keys[::-1], *words.T[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def text_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    out = np.zeros(len(rows), np.uint64)
    for word in big_words(rows).T:
        out = (out ^ word) * SPREAD
        out ^= out >> np.uint64(29)
    return out


def big_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words that sort like the bytes."""
    pad = -rows.shape[1] % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


# --- buckets --------------------------------------------------------------------------------------------------


def blob(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), "zstd", asbytes=True)


def bytes_of(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, "zstd", asbytes=True)


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket and where each bucket begins."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def common_prefix(sorted_rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the row before; -1 at first."""
    other = sorted_rows[1:] != sorted_rows[:-1]
    return np.r_[-1, np.where(other.any(1), other.argmax(1), sorted_rows.shape[1])]


def verdicts(rows: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each context of one bucket, bit d: the window that begins d bytes before it is in a smaller document."""
    reach = length - gram_of(length)
    after, before = rows[:, reach:-2], rows[:, :reach][:, ::-1]
    shallow, deep = rows[:, -1], rows[:, -2]
    ranked = []
    for part in (after, before):
        order = np.lexsort(big_words(part).T[::-1])
        ranked.append((order, common_prefix(part[order])))
    (order_a, prefix_a), (order_b, prefix_b) = ranked
    out = np.zeros((len(rows), (reach + 64) // 64), np.uint64)
    rank_a, rank_b = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for d in range(reach + 1):
        pick = np.flatnonzero((shallow <= d) & (d <= deep))
        if len(pick) < 2:
            continue
        rank_a[order_a] = np.cumsum(prefix_a < length - d)
        rank_b[order_b] = np.cumsum(prefix_b < d)
        name = rank_a[pick] * (len(rows) + 1) + rank_b[pick]
        order = np.lexsort((ids[pick], name))
        name, doc = name[order], ids[pick][order]
        new = np.r_[True, name[1:] != name[:-1]]
        smallest = doc[new][np.cumsum(new) - 1]
        out[pick[order[doc > smallest]], d // 64] |= np.uint64(1 << (d % 64))
    return out


# --- the job --------------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """All columns of docs, and n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    A null text counts as empty and keeps nothing; a null id counts as larger than any other; documents of one id
    do not affect one another; texts shorter than ``length`` bytes lose nothing.  Columns of docs that are named
    like a result give way to it.  whole_characters: a UTF-8 character that loses a byte goes whole.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = {part.split()[0].lower() for part in RESULT.split(", ")}
    rest = [c for c in docs.columns if c.lower() not in names | {id_col.lower(), text_col.lower()}]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), *rest)
    blocks = staged(rows.mapInArrow(lambda batches: to_blocks(batches, block_bytes), "block long, size long, data binary"), "passages-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), math.ceil(total / BUCKET_BYTES))
    width = length - gram_of(length) + length + 2
    mask_words = (length - gram_of(length) + 64) // 64

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes, count = np.unique(Sample(Block(raw.as_py()), length).hash, return_counts=True)
                order, edges = by_bucket(hashes, buckets)
                six = hashes[order].view(np.uint8).reshape(-1, 8)[:, :6]
                full = np.flatnonzero(np.diff(edges))
                count = count[order]
                many = [often(count[edges[b] : edges[b + 1]]) for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array([six[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()), pa.array(many, pa.binary())],
                    names=["bucket", "block", "hashes", "many"],
                )
        release()

    def find_repeated(group: pa.Table) -> pa.Table:
        release()  # what the worker's group before has left, here and below
        raw = group.column("hashes").to_pylist()
        sizes = [len(x) // 6 for x in raw]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
        _, back, count = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        parts = np.split(count[back] > 1, np.cumsum(sizes)[:-1])
        weight = np.ones(len(back), np.int64)
        for at, many in zip(np.cumsum(sizes) - sizes, group.column("many").to_pylist(), strict=True):
            place, n = np.frombuffer(many, np.int64).reshape(2, -1)
            weight[at + place] = n
        warm = np.split((np.bincount(back, weight) > hot)[back], np.cumsum(sizes)[:-1])
        return pa.table(
            {
                "block": group.column("block"), "bucket": group.column("bucket"), "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
                "hot": pa.array([np.packbits(p).tobytes() if p.any() else b"" for p in warm], pa.binary()),
            },
            schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary()), ("hot", pa.binary())]),
        )

    def send_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        out: dict[str, list] = {"bucket": [], "block": [], "n": [], "windows": [], "contexts": []}

        def send(number: int, hashes: np.ndarray, windows: bool, *columns: np.ndarray) -> None:
            order, edges = by_bucket(hashes, buckets)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part = order[edges[b] : edges[b + 1]]
                for name, value in zip(out, (b, number, len(part), windows, blob(*(c[part] for c in columns))), strict=True):
                    out[name].append(value)

        for number, raw in zip(left.column("block").to_pylist(), left.column("data"), strict=True):
            block = Block(raw.as_py())
            sample = Sample(block, length)
            hashes, back = np.unique(sample.hash, return_inverse=True)
            order, edges = by_bucket(hashes, buckets)
            repeated, warm = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
            for b, bits, more in zip(*(right.column(c).to_pylist() for c in ("bucket", "bits", "hot")), strict=True):
                part = order[edges[b] : edges[b + 1]]
                if more:
                    warm[part] = np.unpackbits(np.frombuffer(more, np.uint8), count=len(part)).astype(bool)
                repeated[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)
            if len(hashes):  # or in two documents of this block
                low, high = np.full(len(hashes), len(block.ids)), np.full(len(hashes), -1)
                np.minimum.at(low, back, sample.doc)
                np.maximum.at(high, back, sample.doc)
                repeated |= low < high
            pick = np.flatnonzero(repeated[back]) if len(hashes) else np.zeros(0, np.int64)
            classes = Classes(block, sample, pick, length)
            apart = warm[back[pick[classes.head]]] if len(pick) else np.zeros(0, bool)
            head = classes.head[~apart]
            send(number, sample.hash[pick[head]], False, sample.first[pick[head]], classes.ids[head], classes.rows[head])
            if apart.any():
                windows = Windows(block, sample, pick[classes.head[apart]], length)
                send(number, text_hashes(windows.rows), True, windows.start, windows.ids, windows.rows)
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("windows", pa.bool_()), ("contexts", pa.binary())]))

    def judge(group: pa.Table) -> pa.Table:
        release()
        done = [judged_kind(group.filter(pc.equal(group.column("windows"), kind)), kind) for kind in (False, True)]
        return pa.concat_tables(done)

    def judged_kind(group: pa.Table, windows: bool) -> pa.Table:
        sizes, wide = group.column("n").to_pylist(), length if windows else width
        firsts, ids, rows_ = [], [], []
        for n, raw in zip(sizes, group.column("contexts").to_pylist(), strict=True):
            flat = bytes_of(raw, n * (16 + wide))
            firsts.append(np.frombuffer(flat, np.int64, n))
            ids.append(np.frombuffer(flat, np.int64, n, 8 * n))
            rows_.append(np.frombuffer(flat, np.uint8, n * wide, 16 * n).reshape(n, wide))
        out: list[np.ndarray] = []
        if sizes:
            judge_rows = later_windows if windows else lambda r, i: verdicts(r, i, length)
            out = np.split(judge_rows(np.concatenate(rows_), np.concatenate(ids)), np.cumsum(sizes)[:-1])
        return pa.table(
            {"block": group.column("block"), "n": group.column("n"), "windows": group.column("windows"), "verdicts": pa.array([blob(f, m) for f, m in zip(firsts, out, strict=True)], pa.binary())},
            schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("windows", pa.bool_()), ("verdicts", pa.binary())]),
        )

    schema = T.StructType([f for f in rows.schema.fields] + T._parse_datatype_string(RESULT).fields)
    arrow_types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        parts = []
        for raw in left.column("data"):
            block = Block(raw.as_py())
            gone = covered(block, right, length, mask_words)
            if whole_characters and gone.any():
                begins_one = (block.bytes & 0xC0) != 0x80
                begins_one[block.at[:-1][block.at[:-1] < len(gone)]] = True
                gone = np.logical_or.reduceat(gone, np.flatnonzero(begins_one))[np.cumsum(begins_one) - 1]
            edge = np.flatnonzero(np.diff(np.r_[False, gone].view(np.int8)) == 1)  # where removed runs begin
            begins = np.r_[0, np.cumsum(gone, dtype=np.int64)][block.at]
            inside = gone[np.clip(block.at[:-1], 0, max(0, len(gone) - 1))] & (block.at[1:] > block.at[:-1]) if len(gone) else np.zeros(len(block.ids), bool)
            spans = np.searchsorted(edge, block.at[1:]) - np.searchsorted(edge, block.at[:-1])
            # a run that began in the text before is a run of its own here
            split = inside & ~np.isin(block.at[:-1], edge)
            kept = block.bytes[~gone]
            kept_at = block.at - begins
            done = {
                "n_bytes": pa.array(np.diff(block.at), pa.int64()),
                "n_removed": pa.array(np.diff(begins), pa.int64()),
                "n_spans": pa.array(spans + split, pa.int64()),
                "kept": pa.array([kept[a:b].tobytes() for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)], pa.binary()),
            }
            table_ = block.rows
            for name, values in done.items():
                table_ = table_.append_column(pa.field(name, arrow_types[name]), values)
            parts.append(table_)
        return pa.concat_tables(parts)

    bits = (
        blocks.select("block", "data").mapInArrow(send_hashes, "bucket int, block long, hashes binary, many binary")
        .groupBy("bucket").applyInArrow(find_repeated, "block long, bucket int, bits binary, hot binary")
    )
    data = blocks.select("block", "data")
    judged = (
        data.groupBy("block").cogroup(bits.groupBy("block"))
        .applyInArrow(send_contexts, "bucket int, block long, n long, windows boolean, contexts binary")
        .groupBy("bucket").applyInArrow(judge, "block long, n long, windows boolean, verdicts binary")
    )
    return data.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(cut, schema)


def often(count: np.ndarray) -> bytes:
    """Where a block holds a gram MANY times or more, and how often."""
    at = np.flatnonzero(count >= MANY)
    return np.concatenate([at, count[at]]).astype(np.int64).tobytes()


def later_windows(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window 1 if an equal one is in a smaller document, else 0."""
    smallest, of = smallest_of_equal(rows, ids)
    return (ids > ids[smallest][of]).astype(np.uint8)


def covered(block: Block, verdict_rows: pa.Table, length: int, mask_words: int) -> np.ndarray:
    """The bytes of a block that go."""
    steps = np.zeros(len(block.bytes) + 1, np.int64)
    sample = Sample(block, length)
    firsts, masks = [np.zeros(0, np.int64)], [np.zeros((0, mask_words), np.uint64)]
    starts, flags = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for n, windows, raw in zip(*(verdict_rows.column(c).to_pylist() for c in ("n", "windows", "verdicts")), strict=True):
        flat = bytes_of(raw, n * (9 if windows else 8 * (1 + mask_words)))
        (starts if windows else firsts).append(np.frombuffer(flat, np.int64, n))
        if windows:
            flags.append(np.frombuffer(flat, np.uint8, n, 8 * n))
        else:
            masks.append(np.frombuffer(flat, np.uint64, n * mask_words, 8 * n).reshape(n, mask_words))
    first, mask, start, flag = (np.concatenate(x) for x in (firsts, masks, starts, flags))
    if not len(first) and not len(start):
        return np.zeros(len(block.bytes), bool)
    heads = np.searchsorted(sample.first, first)  # first windows are in order
    apart = np.unique(sample.hash[np.searchsorted(sample.first, start, "right") - 1])
    pick = np.flatnonzero(np.isin(sample.hash, np.concatenate([sample.hash[heads], apart])))
    classes = Classes(block, sample, pick, length)
    of_class = np.zeros((len(classes.head), mask_words), np.uint64)
    of_class[classes.of[np.searchsorted(pick, heads)]] = mask
    if len(start):  # the same windows as were sent, and their verdicts in the form of the others
        at = np.flatnonzero(np.isin(sample.hash[pick[classes.head]], apart))
        sent = Windows(block, sample, pick[classes.head[at]], length)
        verdict = np.zeros(len(sent.start), bool)
        order = np.argsort(sent.start)
        verdict[order[np.searchsorted(sent.start, start, sorter=order)]] = flag.astype(bool)
        late = sent.later | verdict[sent.of]
        depth = sent.depth[late].astype(np.uint64)
        np.bitwise_or.at(of_class, (at[sent.owner[late]], depth // np.uint64(64)), np.uint64(1) << (depth % np.uint64(64)))
    where, count, anchor = sample.first[pick], sample.count[pick], sample.anchor[pick]
    late = classes.later
    np.add.at(steps, where[late], 1)
    np.add.at(steps, where[late] + count[late] - 1 + length, -1)
    own = np.flatnonzero(~late)
    verdict = of_class[classes.of[own]]
    for d in range(length - gram_of(length) + 1):
        hit = own[(verdict[:, d // 64] >> np.uint64(d % 64)) & np.uint64(1) == 1]
        np.add.at(steps, anchor[hit] - d, 1)
        np.add.at(steps, anchor[hit] - d + length, -1)
    return np.cumsum(steps[:-1]) > 0


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_passages": op10_passages}
ORACLE_SQL: dict[str, str] = {}
