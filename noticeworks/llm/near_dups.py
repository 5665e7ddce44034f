"""Operator 3: near duplicates by BagMinHash signatures, bands and verified multiset overlap.

A document is the multiset of its five-word shingles (lower case, split at white space; a shorter text is one
shingle).  BagMinHash gives every unit of a shingle's count its own Poisson process of points, each in a random
register; a register keeps its first point, and two registers agree with probability equal to the weighted Jaccard
similarity.  The units are a hierarchy of dyadic intervals [0,1), [1,2), [2,4), ...: an interval is one process of
that rate, thinned to the units below the count, so a count costs its logarithm, and a process is followed only
until it passes the slowest register of its document.

Equal texts are one node from the start.  Nodes that share a band are tested against leaders of that bucket -
first its smallest node, then, while the bucket holds more than one component, 1, 2, 4, ... more of its nodes drawn
by hash, until every node has led or few lie outside the largest component there, which then lead at once.  Nodes
already connected are not tested again, and a node leaves a bucket once the shingles that it shares with any other
open node are too few for a link there.  So a group of copies costs about its size rather than its square, and no pair
that could still join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.common import Growing, release, staged, table

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**24 = 7e-5.
BANDS, ROWS = 24, 5
#: Words that are hashed at once; words that a worker remembers.
BATCH_WORDS, CACHED_WORDS = 500_000, 200_000
#: Turns led by the nodes that share most; then so many times more leaders of a bucket in each turn.
CENTRES, GROWTH = 2, 8
#: Rows of one bucket or pairs of one node that one task takes; the other side is repeated for each such part.
PART_ROWS = 256
#: A list of at most so many ids is broadcast (16 MB); a longer one is shuffled.
BROADCAST_IDS = 1_000_000
#: Edges that one task joins into components (some 20 MB); more are joined by label passing.
SMALL_EDGES = 100_000

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


class Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


WORDS = Words()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every shingle, with repeats."""
    import xxhash

    docs, hashes = [], []
    words = [np.fromiter(map(WORDS.__getitem__, w), np.uint64, len(w)) for w in (t.lower().split() for t in texts)]
    long = [i for i, w in enumerate(words) if len(w) > SHINGLE]
    for i, w in enumerate(words):
        if 0 < len(w) <= SHINGLE:
            docs.append(np.array([i]))
            hashes.append(np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64))
    if long:
        flat = np.concatenate([words[i] for i in long])
        sizes = np.array([len(words[i]) for i in long])
        n = len(flat) - SHINGLE + 1
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h = mix(h * STEP + flat[k : k + n])
        ends = np.cumsum(sizes)
        inside = np.ones(n, bool)
        for k in range(1, SHINGLE):  # those that would run into the next text
            at = ends[:-1] - k
            inside[at[at < n]] = False
        docs.append(np.repeat(np.array(long), sizes)[:n][inside])
        hashes.append(h[inside])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def bags(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and its count."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])]) if len(docs) else np.zeros(0, np.int64)
    return docs[new], hashes[new], np.diff(np.r_[new, len(docs)])


def times(n: int) -> np.uint64:
    return np.uint64(n * int(STEP) & (1 << 64) - 1)


def uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def bag_min_hash(docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers first points; infinite for documents without shingles."""
    doc, seed, base, top = [docs], [mix(hashes + STEP)], [np.zeros(len(docs), np.int64)], [counts]
    low = 1
    while (pick := np.flatnonzero(counts > low)).size:
        doc.append(docs[pick])
        seed.append(mix(hashes[pick] + times(low + 1)))
        base.append(np.full(len(pick), low, np.int64))
        top.append(counts[pick])
        low *= 2
    doc, seed, base, top = (np.concatenate(x) for x in (doc, seed, base, top))
    rate = np.maximum(base, 1).astype(np.float64)
    out = np.full(n * registers, np.inf)
    x = np.zeros(len(doc))
    turn = 0
    while len(doc):
        turn += 1
        draw = mix(seed + times(2 * turn))
        x = x - np.log(uniform(draw)) / rate
        other = mix(draw + STEP)
        register = (other % np.uint64(registers)).astype(np.int64)
        unit = base + (uniform(mix(other + STEP)) * rate).astype(np.int64)
        hit = (unit < top) | (base == 0)
        np.minimum.at(out, doc[hit] * registers + register[hit], x[hit])
        slowest = out.reshape(n, registers).max(1)
        on = x < slowest[doc]
        doc, seed, base, top, rate, x = doc[on], seed[on], base[on], top[on], rate[on], x[on]
    return out.reshape(n, registers)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64)
    out = np.empty((len(bits), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(bits), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * STEP + bits[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, some hundred thousand words at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(text.as_py() or "")
            size += len(texts[-1]) // 5
            if size >= BATCH_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, content (equal for equal word sequences), n shingles, bands (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, texts in portions(batches):
            doc, hashes = shingles(texts)
            n = np.bincount(doc, minlength=len(texts))
            found = band_hashes(bag_min_hash(*bags(doc, hashes), len(texts), bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(" ".join(t.lower().split())) for t in texts], pa.binary()),
                    pa.array(n, pa.int64()),
                    pa.array([b if k else None for b, k in zip(found.tolist(), n.tolist(), strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "content", "n", "bands"],
            )
        WORDS.clear()  # workers outlive their tasks, and later stages need the memory
        release()

    return docs.mapInArrow(run, "doc_id long, content binary, n long, bands array<long>")


def numbered_shingles(docs: DataFrame) -> DataFrame:
    """node and its shingles, the k-th copy of one counted as another: multiset overlap is then set overlap.

    32 bits each: two documents of n shingles agree by chance in n * n / 2**32 of them, which can only add to an overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in portions(batches):
            doc, hashes = shingles(texts)
            order = np.lexsort((hashes, doc))
            doc, hashes = doc[order], hashes[order]
            at = np.arange(len(doc))
            new = np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])] if len(doc) else np.zeros(0, bool)
            copy = at - np.maximum.accumulate(np.where(new, at, 0)) if len(doc) else at
            short = (mix(hashes + copy.astype(np.uint64) * STEP) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(short, pa.int32()))], names=["node", "shingles"]
            )
        WORDS.clear()
        release()

    return docs.mapInArrow(run, "node long, shingles array<int>")


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of edges (a, b) by union-find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((top(a), top(b)))
            up[high] = low
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges (a, b), by minimum labels and pointer jumping.

    known: labels of a part of these edges, from which to go on.  So few edges as SMALL_EDGES are joined by one task in one
    job: each turn of label passing is a plan with three joins, whose code the driver keeps.
    """
    if edges.count() <= SMALL_EDGES:
        return staged(edges.select("a", "b").coalesce(1).mapInArrow(united, "node long, component long"), "near-labels", narrow=True)
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    if known is not None:
        old = known.withColumnRenamed("component", "old")
        labels = labels.join(old, "node", "left").select("node", F.least("component", "old").alias("component"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        new = labels.join(near, labels.node == near.a).select("node", F.least("component", "least").alias("new"), F.col("component").alias("old"))
        up = new.select(F.col("node").alias("new"), F.col("new").alias("component"))
        new = new.join(up, "new").select("node", "component", (F.col("component") != F.col("old")).alias("moved"))
        new = staged(new, "near-labels", narrow=True)
        labels = new.select("node", "component")
        if not new.filter("moved").limit(1).count():
            return labels


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: the smallest id of the documents that are linked to it by similarity >= ``similarity``.

    Null texts count as empty; empty texts are copies of one another, and so are texts that differ only in case and
    white space.  Rows of one id get one class, the smallest of theirs; a row with a null id takes no part and has
    itself as class (null).  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(signatures(texts.filter("doc_id IS NOT NULL")), "near-signatures")
    first = staged(
        signed.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-nodes"
    )
    rows = first.filter("bands IS NOT NULL").select("node", "n", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    sizes = staged(sizes, "near-sizes", narrow=True)
    buckets = staged(rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "bucket"), "near-buckets")

    nodes = staged(buckets.select(F.col("node").alias("doc_id")).distinct(), "near-candidates", narrow=True)
    few = nodes.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")
    sets = staged(numbered_shingles(chosen), "near-shingles")

    def with_shingles(pairs: DataFrame, side: str, other: str) -> DataFrame:
        """pairs and of_<side>; a node of very many pairs meets them in parts of PART_ROWS."""
        hot = pairs.groupBy(side).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).filter("parts > 1")
        hot = staged(hot, "near-hot", narrow=True)
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
        rows = pairs.join(hot, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        of = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}")).join(hot, side, "left")
        of = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return rows.join(of, [side, "part"]).drop("part")

    def scored(pairs: DataFrame) -> DataFrame:
        """a, b, both (common shingles), hit (similar enough)."""
        rows = with_shingles(with_shingles(pairs, "b", "a"), "a", "b").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
        hit = F.col("both") >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - F.col("both")) - 1e-9
        return staged(rows.select("a", "b", "both", hit.alias("hit")), "near-links", narrow=True)

    alike = "least(n, m) >= {0} * greatest(n, m) - 1e-9".format(similarity)  # else the overlap is too small anyway
    heads = first.select(F.col("node").alias("leader"), F.col("n").alias("m"))
    pairs = buckets.filter("node <> leader").select("leader", "node", "n").distinct().join(heads, "leader").filter(alike)
    pairs = staged(pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")), "near-pairs", narrow=True)
    with_leader = scored(pairs)
    spark, led = docs.sparkSession, 1
    tested, edges = Growing(spark, "near-tested", "a long, b long"), Growing(spark, "near-edges", "a long, b long")
    tested.add(pairs)
    edges.add(with_leader.filter("hit").select("a", "b"))
    labels = components(edges.rows())
    share = similarity / (1 + similarity)  # of n + m that the overlap must reach

    def still_split(rows: DataFrame) -> DataFrame:
        """Rows of buckets with nodes of two components, without nodes that are too lonely to link to any node there.

        main: the largest component of the bucket; outside_main: how many nodes at most are in others.
        """
        parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.min("n").alias("low"))
        main = F.max_by("component", F.struct(F.col("k"), -F.col("component"))).alias("main")
        parts = parts.groupBy("bucket").agg(F.min("low").alias("low"), main, (F.sum("k") - F.max("k")).alias("outside_main"))
        near = F.greatest(F.col("low"), F.lit(similarity) * F.col("n"))
        rows = rows.drop("main", "outside_main").join(parts.filter("outside_main > 0"), "bucket")
        return rows.filter(F.col("own") >= share * (F.col("n") + near) - 1e-9).drop("low")

    def with_components(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    rest = still_split(with_components(buckets.filter("size > 2").withColumn("own", F.col("n"))))
    rest = staged(rest.select("bucket", "node", "n", "size", "leader", "component"), "near-open", narrow=True)
    # of the open buckets that two nodes share, the smallest one tests them, once leaders are many
    among = rest.groupBy("node").agg(F.collect_list("bucket").alias("among"))
    # shingles that no other node of an open bucket has can be in no overlap
    lone = sets.join(rest.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    lone = lone.groupBy("shingle").agg(F.count("*").alias("copies"), F.min("node").alias("node")).filter("copies = 1")
    lone = lone.groupBy("node").agg(F.count("*").alias("lone"))
    rest = rest.join(lone, "node", "left").withColumn("own", F.col("n") - F.coalesce("lone", F.lit(0)))
    # two nodes have in common what both share with the leader of the bucket, and else only what they share with others
    overlap = with_leader.groupBy(F.col("a").alias("leader"), F.col("b").alias("node")).agg(F.max("both").alias("both"))
    rest = still_split(rest).drop("lone").join(overlap, ["leader", "node"], "left")
    rest = rest.join(among, "node")
    first_node = F.col("node") == F.col("leader")
    rest = rest.withColumn("inside", F.when(first_node, F.col("n")).otherwise(F.coalesce("both", "own")))
    beyond = F.greatest(F.lit(0), F.col("own") - F.coalesce("both", F.lit(0)))
    rest = staged(rest.withColumn("outside", F.when(first_node, F.lit(0)).otherwise(beyond)).drop("both"), "near-open", narrow=True)
    rest = rest.withColumn("led", F.col("node") == F.col("leader"))
    turns = 0
    while rest.limit(1).count():
        turns += 1
        if turns <= CENTRES:  # the node that shares most of itself with others is likely what the others were made from
            best = F.max_by("node", F.struct(F.col("own") / F.col("n"), -F.col("node")))
            heads = rest.filter("NOT led").groupBy("bucket").agg(best.alias("head"))
            rest = rest.join(heads, "bucket", "left").withColumn("leads", F.coalesce(F.col("node") == F.col("head"), F.lit(False))).drop("head")
        else:
            turn = F.pmod(F.xxhash64("bucket", "node"), F.col("size"))
            last = (F.col("outside_main") <= GROWTH * led) & F.lit(led > 1)
            drawn = (turn < GROWTH * led) & ((turn >= led) | F.lit(led == 1))
            rest = rest.withColumn("leads", F.when(last, F.col("component") != F.col("main")).otherwise(drawn) & ~F.col("led")).withColumn("last", last)
        rest = staged(rest, "near-open", narrow=True)
        lead = rest.filter("leads").select("bucket", F.ceil(F.col("size") / PART_ROWS).cast("int").alias("parts"), F.col("node").alias("head"), F.col("n").alias("m"), F.col("own").alias("others"), F.col("component").alias("other"), F.col("inside").alias("inside_2"), F.col("outside").alias("outside_2"), F.col("among").alias("among_2"))
        most = F.least(F.least("own", "others"), F.least("inside", "inside_2") + F.least("outside", "outside_2"))
        owned = F.col("bucket") == F.array_min(F.array_intersect("among", "among_2"))
        # a bucket's rows meet its leaders in parts
        parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
        lead = lead.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        new = (
            rest.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).join(lead, ["bucket", "part"])
            .filter("component != other").filter(alike).filter(owned | F.lit(turns <= CENTRES))
            .filter(most >= share * (F.col("n") + F.col("m")) - 1e-9)
            .select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
            .join(tested.rows(), ["a", "b"], "left_anti")
        )
        new = staged(new, "near-pairs", narrow=True)
        if new.limit(1).count():
            tested.add(new)
            edges.add(scored(new).filter("hit").select("a", "b"))
            labels = components(edges.rows(), labels)
        if turns > CENTRES:
            led *= GROWTH
            rest = rest.filter("NOT last").drop("last")
        rest = rest.withColumn("led", F.col("led") | F.col("leads")).drop("leads", "component")
        rest = still_split(with_components(rest.filter((F.col("size") > led) | F.lit(turns <= CENTRES))))
        rest = staged(rest, "near-open", narrow=True)
    named = first.join(labels, "node", "left").select("content", F.coalesce("component", "node").alias("class_id"))
    out = signed.join(named, "content").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    none = texts.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(none)


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its class (and those without an id), all columns as they are."""
    classes = near_classes(docs, similarity, id_col, text_col)
    drop = staged(classes.filter("doc_id <> class_id").select(F.col("doc_id").alias(id_col)), "near-dropped")
    few = drop.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(drop) if few else drop, id_col, "left_anti").select(*docs.columns)


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_dups": op3_near_dups}
ORACLE_SQL: dict[str, str] = {}
