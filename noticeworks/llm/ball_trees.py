"""Exact searches by inner product over sharded ball trees: what top-k search and hard-negative mining share.

Rows are dealt to cells, each to the nearest of a few centres that are fitted on a bounded sample.  A cell of more rows
than a shard holds is dealt on to centres of its own (a second level, fitted in a task a cell), and only what still
crowds one centre - equal or nearly equal vectors - is dealt by id.  Each shard builds one ball tree, once; trees are
stored a row a shard.  A query visits cells in waves, those with the highest bound first; what it has found so far gives
the scores that later cells must reach, and bounds of the second level leave sub-cells out before anything is sent.

A task answers a shard's queries in blocks of BLOCK_QUERIES: as many rows as a shard holds, so that the copies of a
shard that many queries visit never weigh more than those queries themselves.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import shuffle_partitions, staged

#: Rows of a shard and queries that one task answers: what it holds (at 64 dimensions 8 MB each).
SHARD_ROWS = BLOCK_QUERIES = 16_384
LEAF = 64
#: Rows for which a cell of its own is worth while; most cells of one dimension, and most sub-cells of a cell; components
#: of the sample that the centres are fitted on (32 MB on the driver, or in a task), and rows of it for each cell.
CELL_ROWS, MOST_CELLS, SAMPLE_COMPONENTS, SAMPLE_PER_CELL = 1_024, 1_024, 4_000_000, 32
#: Cells that a query has visited after each wave; the last wave visits all that are left.
WAVES = (1, 8, 64)
#: Tables of cells and shards (a few numbers a row) that are broadcast at most; longer ones are shuffled.
BROADCAST_ROWS = 200_000
#: Below this, sums of products are exact in double precision.
EXACT = 2.0**53

CELL = ["dim", "grp", "cell"]
SHARD = [*CELL, "sub", "deal"]
SHARD_TYPES = "dim int, grp long, cell int, sub int, deal int"


# --- one tree ----------------------------------------------------------------------------------------------------


class BallTree:
    """Integer vectors in a binary tree of balls; each leaf is a run of rows of ``sorted``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        nodes: list[list] = []  # centre, radius, from, to, children
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = points[order[a:b]]
            centre = rows.mean(0)
            far = ((rows - centre) ** 2).sum(1)
            if parent >= 0:
                nodes[parent][4 + side] = len(nodes)
            nodes.append([centre, widened(math.sqrt(far.max())), a, b, -1, -1])
            if b - a > leaf:
                one = rows[far.argmax()]
                other = rows[((rows - one) ** 2).sum(1).argmax()]
                along = rows @ (other - one)
                if along.min() < along.max():
                    part, half, me = np.argsort(along, kind="stable"), (b - a) // 2, len(nodes) - 1
                    order[a:b] = order[a:b][part]
                    todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
        self.order, self.sorted = order, points[order]
        self.centres, self.radii = np.stack([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.spans = np.array([n[2:] for n in nodes], np.int64)
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.largest = float(np.abs(points).max()) if points.size else 0.0


def widened(radius):
    """A little more than a radius: floating-point sums must not hide a point."""
    return radius * (1 + 1e-9) + 1e-6


def upper_bounds(query: np.ndarray, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """At least the inner product of query with any point of each ball."""
    length = math.sqrt(float(query @ query))
    return centres @ query + radii * length + 1e-11 * length * (norms + radii) + 1e-6


class Shard:
    """A tree, and of each of its points the smallest ids, with labels, that any search for k rows can ask for."""

    def __init__(self, group: pd.DataFrame, k: int):
        rows = matrix(group["v"])
        points, of = np.unique(rows, axis=0, return_inverse=True) if rows.shape[1] else (rows[:1], np.zeros(len(rows), np.int64))
        self.members: list[list[tuple[int, int]]] = [[] for _ in points]
        held: list[dict[int, int]] = [{} for _ in points]
        for at, vec_id, label in sorted(zip(of.ravel().tolist(), group["vec_id"].tolist(), group["label"].tolist(), strict=True)):
            own, count = self.members[at], held[at]
            n = count.get(label, 0)
            # k copies of an id are enough, and of each label k ids besides the query's own, and those of other labels than any one
            if n < 2 * k and len(own) - max(count.values(), default=0) < 2 * k and not (n >= k and sum(m == (vec_id, label) for m in own[-k:]) == k):
                own.append((vec_id, label))
                count[label] = n + 1
        self.tree = BallTree(points)
        low = np.array([min(c) for c in held], np.int64)[self.tree.order]
        high = np.array([max(c) for c in held], np.int64)[self.tree.order]
        #: Labels of each node: one label only where both are equal.
        self.low = np.array([low[a:b].min() for a, b in self.tree.spans[:, :2]])
        self.high = np.array([high[a:b].max() for a, b in self.tree.spans[:, :2]])
        for kind in (np.int16, np.int32):
            if self.tree.largest < np.iinfo(kind).max:
                self.tree.sorted = self.tree.sorted.astype(kind)
                break

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps(self), 1)


def opened(raw: bytes) -> Shard:
    shard = pickle.loads(zlib.decompress(raw))
    shard.tree.sorted = shard.tree.sorted.astype(np.float64)
    return shard


class Best:
    """The k highest (score, smaller id first) of scores between ``floor`` and ``ceiling``; floor may be a known k-th score."""

    def __init__(self, k: int, floor: float, ceiling: float = math.inf):
        self.k, self.floor, self.ceiling, self.heap = k, floor, ceiling, []

    def bound(self) -> float:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def offer(self, score: int, vec_id: int) -> None:
        item = (score, -vec_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)


def search(shard: Shard, query: np.ndarray, own: int, wanted: list[Best], other_than: int | None = None) -> None:
    """Offers to each of ``wanted`` the rows it can use, all but those of id ``own``, and of label ``other_than``.

    Nodes come in falling order of their upper bound; one is left out that holds no other label, or that for each of
    ``wanted`` lies below its k-th score (or floor) or above its ceiling.
    """
    tree = shard.tree
    upper = upper_bounds(query, tree.centres, tree.radii, tree.norms)
    capped = any(b.ceiling < math.inf for b in wanted)
    lower = -upper_bounds(-query, tree.centres, tree.radii, tree.norms) if capped else None
    wide = float(np.abs(query).max(initial=0.0)) * tree.largest * len(query) >= EXACT
    # what a score in double precision may be off by; 0 where it is exact
    off = 1e-11 * math.sqrt(float(query @ query)) * float(tree.norms[0] + tree.radii[0]) if wide else 0.0
    whole = [int(x) for x in query] if wide else None
    todo = [(-upper[0], 0)]
    while todo:
        high, at = heapq.heappop(todo)
        open_ = [b for b in wanted if -high >= b.bound() and (lower is None or lower[at] <= b.ceiling)]
        if not open_:
            if all(-high < b.bound() for b in wanted):
                return
            continue
        if other_than is not None and shard.low[at] == shard.high[at] == other_than:
            continue
        a, b, left, right = tree.spans[at]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(todo, (-upper[child], child))
            continue
        scores = tree.sorted[a:b] @ query
        for best in open_:
            near = scores >= best.bound() - off
            if best.ceiling < math.inf:
                near &= scores <= best.ceiling + off
            for i in np.flatnonzero(near).tolist():
                score = sum(x * int(y) for x, y in zip(whole, tree.sorted[a + i], strict=True)) if wide else int(scores[i])
                if best.bound() <= score <= best.ceiling:
                    for vec_id, label in shard.members[tree.order[a + i]]:
                        if vec_id != own and label != other_than:
                            best.offer(score, vec_id)


# --- cells and shards --------------------------------------------------------------------------------------------


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of whole numbers in double precision."""
    return np.stack([np.asarray(x, np.float64) for x in column])


def clean(vectors: DataFrame, id_col: str, vector_col: str, scale: int, label_col: str | None = None) -> DataFrame:
    """vec_id, dim, v: floor(scale * x), label (0 without one); no null ids, labels, vectors, components nor non-finite ones."""
    x = F.col("x")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    floor = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  a larger one is whole
    label = F.lit(0) if label_col is None else F.col(label_col)
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), label.cast("long").alias("label"))
    picked = picked.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    return picked.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda e: floor(e * scale)).alias("v"), "label")


def fitted_centres(points: np.ndarray, cells: int, turns: int = 4) -> np.ndarray:
    """At most so many centres of a sample, by a few turns of k-means."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:cells]]
    for _ in range(turns):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(points[i : i + 8192] @ centres.T - half, 1) for i in range(0, len(points), 8192)])


def centres_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centres of the cells, for each dimension that has rows enough for more than one: a bounded sample is fitted."""
    out: dict[int, np.ndarray] = {}
    counts = rows.filter("dim > 0").groupBy("dim").count().filter(F.col("count") > CELL_ROWS)
    for dim, n in sorted((r.dim, r["count"]) for r in counts.collect()):
        cells = max(math.ceil(n / SHARD_ROWS), min(2 * shuffle_partitions(rows.sparkSession), math.ceil(n / CELL_ROWS)))
        cells = min(cells, MOST_CELLS, max(1, SAMPLE_COMPONENTS // SAMPLE_PER_CELL // dim))
        wanted = cells * SAMPLE_PER_CELL
        sample = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(max(1, n // wanted))) == 0))
        sample = sample.select("v").limit(wanted).toPandas()
        if cells > 1 and len(sample):
            out[dim] = fitted_centres(matrix(sample["v"]), cells)
    return out


def with_cells(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell (the nearest centre, 0 where there are none) and far, the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim in centres:
                    at = np.flatnonzero(dims == dim)
                    points = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                    cell[at] = nearest(points, centres[dim])
                    far[at] = np.sqrt(((points - centres[dim][cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec_id", "dim", "v", "label", "cell", "far"])

    return rows.select("vec_id", "dim", "v", "label").mapInArrow(run, "vec_id long, dim int, v array<double>, label long, cell int, far double")


def small(df: DataFrame) -> DataFrame:
    """Broadcast where its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Shards:
    """Trees over rows (vec_id, dim, v, label, cell, far, grp): ``trees`` has SHARD and data, ``sizes`` SHARD without deal, and deals.

    ``cells`` has the centres and radii of each dimension that has several; ``inner`` has, for each cell that is dealt
    on, the centres and radii of its sub-cells.  k: as many rows of one vector, and label, are kept as a search for k needs.
    """

    def __init__(self, rows: DataFrame, centres: dict[int, np.ndarray], k: int):
        self.cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if centres:
            known = rows.filter(F.col("dim").isin(list(centres))).groupBy("dim", "cell").agg(F.max("far").alias("far")).toPandas()
            for dim, centre in centres.items():  # no more rows than there are centres
                mine = known[known["dim"] == dim]
                ids = mine["cell"].to_numpy()
                self.cells[dim] = ids, centre[ids], widened(mine["far"].to_numpy())
        self.inner: DataFrame | None = None
        counts = staged(rows.groupBy(*CELL).agg(F.count("*").alias("n")), "trees-cells", narrow=True)
        large = counts.filter((F.col("n") > SHARD_ROWS) & (F.col("dim") > 0))
        rows = rows.drop("far").withColumn("sub", F.lit(0))
        if large.limit(1).count():
            rows = self._dealt_on(rows, large)
        sizes = rows.groupBy(*CELL, "sub").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("deals"))
        self.sizes = staged(sizes, "trees-sizes", narrow=True)
        many = self.sizes.filter("deals > 1")
        if many.limit(1).count():
            rows = rows.join(small(many), [*CELL, "sub"], "left")
            rows = rows.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
        else:
            rows = rows.withColumn("deal", F.lit(0))

        def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, Shard(group, k).packed())], columns=[*SHARD, "data"])

        self.trees = staged(rows.select(*SHARD, "vec_id", "label", "v").groupBy(*SHARD).applyInPandas(build, f"{SHARD_TYPES}, data binary"), "trees")

    def _dealt_on(self, rows: DataFrame, large: DataFrame) -> DataFrame:
        """Rows of large cells get sub, the nearest of their cell's own centres; the radii of these go to ``inner``."""
        subs = F.least(F.lit(MOST_CELLS), F.ceil(F.col("n") / SHARD_ROWS) * 2, F.greatest(F.lit(1), F.floor(F.lit(SAMPLE_COMPONENTS // SAMPLE_PER_CELL) / F.col("dim"))))
        large = staged(large.withColumn("subs", subs.cast("int")), "trees-large", narrow=True)
        known = small(large)
        mine = rows.join(known, CELL)
        wanted = F.col("subs") * SAMPLE_PER_CELL
        sample = mine.filter(F.pmod(F.xxhash64("vec_id", F.lit(6)), F.greatest(F.lit(1), F.floor(F.col("n") / wanted))) == 0)

        def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            most = int(group["subs"].iloc[0])
            points = matrix(group["v"].iloc[: 4 * most * SAMPLE_PER_CELL])
            return pd.DataFrame([(*key, pickle.dumps(fitted_centres(points, most)))], columns=[*CELL, "centres"])

        fitted = staged(sample.select(*CELL, "subs", "v").groupBy(*CELL).applyInPandas(fit, "dim int, grp long, cell int, centres binary"), "trees-fitted")
        parts = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / SHARD_ROWS)).cast("int")
        mine = mine.withColumn("part", parts).drop("n", "subs", "sub")
        copies = fitted.join(large, CELL).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SHARD_ROWS).cast("int") - 1)))

        names = [*mine.columns, "sub", "away"]

        def assign(stored: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
            if not len(group):
                return pd.DataFrame(columns=names)
            if not len(stored):  # the sample missed the cell: one sub-cell, which bounds nothing
                return group.assign(sub=0, away=math.inf)
            centres, points = pickle.loads(stored["centres"].iloc[0]), matrix(group["v"])
            near = nearest(points, centres)
            return group.assign(sub=near, away=np.sqrt(((points - centres[near]) ** 2).sum(1)))

        key = [*CELL, "part"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mine.schema.fields) + ", sub int, away double"
        dealt = copies.select(*key, "centres").groupBy(*key).cogroup(mine.groupBy(*key)).applyInPandas(assign, schema)
        dealt = staged(dealt.drop("part"), "trees-dealt")
        radii = dealt.groupBy(*CELL, "sub").agg(F.max("away").alias("away")).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("sub", "away"))).alias("subs"))
        self.inner = staged(radii.join(fitted, CELL, "left"), "trees-inner")
        rest = rows.join(known.select(*CELL), CELL, "left_anti")
        return rest.unionByName(dealt.drop("away"))

    def promising(self, asked: DataFrame, first: int, last: int | None) -> DataFrame:
        """asked (query_id, dim, grp, v, low, high, one_cell, ...) with each query's first to last cells in falling order of their bounds.

        Only cells that can hold a score between low and high (null: no limit).  A dimension without centres, and a
        query with one_cell, has one cell, 0.
        """
        cells, names = self.cells, [*asked.columns, "cell"]
        at = {n: i for i, n in enumerate(asked.columns)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pick, cell = [], []
                dims, lows, highs, ones = (batch.column(at[n]).to_pylist() for n in ("dim", "low", "high", "one_cell"))
                for i, (dim, v, low, high, one) in enumerate(zip(dims, batch.column(at["v"]), lows, highs, ones, strict=True)):
                    if dim in cells and not one:
                        ids, centres, radii = cells[dim]
                        query, norms = np.asarray(v.values, np.float64), np.sqrt((centres**2).sum(1))
                        upper, lower = upper_bounds(query, centres, radii, norms), -upper_bounds(-query, centres, radii, norms)
                        order = np.argsort(-upper, kind="stable")[first:last]
                        order = order[(upper[order] >= (-math.inf if low is None else low)) & (lower[order] <= (math.inf if high is None else high))]
                        pick += [i] * len(order)
                        cell += ids[order].tolist()
                    elif first == 0:
                        pick.append(i)
                        cell.append(0)
                out = batch.take(pa.array(pick, pa.int64()))
                for a in range(0, len(cell), 10_000):
                    part = out.slice(a, 10_000)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[a : a + 10_000], pa.int32())], names=names)

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
        return asked.mapInArrow(run, f"{schema}, cell int")

    def _to_subs(self, pairs: DataFrame) -> DataFrame:
        """Pairs with sub: in cells that were dealt on, those sub-cells whose bounds meet the query's scores."""
        large = self.inner.select(*CELL)
        plain = pairs.join(small(large), CELL, "left_anti").withColumn("sub", F.lit(0))
        blocks = staged(pairs.join(small(large), CELL, "left_semi").groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")), "trees-blocks", narrow=True)
        dealt = pairs.join(small(blocks), CELL).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        copies = self.inner.join(blocks, CELL).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        names = [*dealt.columns, "sub"]

        def bounded(stored: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
            if not len(stored) or not len(group):
                return pd.DataFrame(columns=names)
            ids = np.array([s["sub"] for s in stored["subs"].iloc[0]])
            radii = widened(np.array([s["away"] for s in stored["subs"].iloc[0]]))
            raw = stored["centres"].iloc[0]
            centres = None if raw is None else pickle.loads(raw)[ids]
            norms = None if raw is None else np.sqrt((centres**2).sum(1))
            pick, sub = [], []
            for i, (v, low, high) in enumerate(zip(group["v"], group["low"], group["high"], strict=True)):
                keep = ids
                if centres is not None:
                    query = np.asarray(v, np.float64)
                    upper, lower = upper_bounds(query, centres, radii, norms), -upper_bounds(-query, centres, radii, norms)
                    keep = ids[(upper >= (-math.inf if pd.isna(low) else low)) & (lower <= (math.inf if pd.isna(high) else high))]
                pick += [i] * len(keep)
                sub += keep.tolist()
            return group.iloc[pick].assign(sub=sub)

        key = [*CELL, "block"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", sub int"
        found = copies.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(bounded, schema).drop("block")
        return plain.unionByName(found)

    def answered(self, pairs: DataFrame, answer: Callable[[Shard, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """answer(shard, its queries) for each shard and block of the queries that visit it."""
        names = [part.split()[0] for part in schema.split(", ")]
        pairs = staged(pairs, "trees-pairs")
        if self.inner is not None:
            pairs = staged(self._to_subs(pairs), "trees-sub-pairs")
        else:
            pairs = pairs.withColumn("sub", F.lit(0))
        blocks = pairs.groupBy(*CELL, "sub").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
        blocks = staged(blocks.join(self.sizes, [*CELL, "sub"]), "trees-parts", narrow=True)
        known = small(blocks)
        left = self.trees.join(known.drop("deals"), [*CELL, "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = pairs.join(known, [*CELL, "sub"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks", "deals")

        def run(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(stored) or not len(wanted):
                return pd.DataFrame(columns=names)
            return answer(opened(stored["data"].iloc[0]), wanted)

        key = [*SHARD, "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)

    def waves(self) -> list[tuple[int, int | None]]:
        """First and last cell of each wave."""
        most = max([len(c[0]) for c in self.cells.values()], default=1)
        ends = [w for w in WAVES if w < most]
        return list(zip([0, *ends], [*ends, None]))


# --- top-k -------------------------------------------------------------------------------------------------------


def just_below(score):
    """A column of whole scores as doubles, none larger than the score itself."""
    as_double = score.cast("double")
    return F.when(F.abs(as_double) < EXACT, as_double).otherwise(as_double - F.abs(as_double) * 1e-15)


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys and best: the k best (low = -score, vec_id) of each, in order."""
    return found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, k).alias("best"))


def fits(scores) -> None:
    if any(abs(score) >= 1 << 63 for score in scores):
        raise OverflowError("a score is too large for 64 bits")


def highest(shards: Shards, asked: DataFrame, k: int) -> DataFrame:
    """query_id and best (low = -score, vec_id): the k best rows of each query's group.  asked: query_id, dim, grp, v, one_cell."""

    def answer(shard: Shard, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for query_id, query, low in zip(wanted["query_id"].tolist(), matrix(wanted["v"]), wanted["low"].tolist(), strict=True):
            best = Best(k, -math.inf if low is None or math.isnan(low) else low)
            search(shard, query, query_id, [best])
            out += [(query_id, -minus, score) for score, minus in best.heap]
        fits(score for _, _, score in out)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    best, high = None, F.lit(None).cast("double").alias("high")
    for first, last in shards.waves():
        if best is None:
            left = asked.withColumn("low", F.lit(None).cast("double"))
        else:
            low = F.when(F.size("best") >= k, -F.element_at("best", -1)["low"])
            left = asked.join(best.select("query_id", just_below(low).alias("low")), "query_id", "left")
        pairs = shards.promising(left.select("query_id", "dim", "grp", "v", "one_cell", "low", high), first, last)
        found = shards.answered(pairs, answer, "query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.select("query_id", F.explode("best").alias("hit")).select("query_id", "hit.vec_id", (-F.col("hit.low")).alias("score")))
        best = staged(best_of(found, ["query_id"], k), "trees-best")
    return best
