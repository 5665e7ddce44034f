"""Linking announcements that speak of the same call: by official code, by page address, by title.

The order matters: announcements are taken oldest first, a call is known only from those before, and every linked
announcement makes its call known by one title, code and address more.  What is alike but not surely the same stays in doubt,
linked to nothing.  A decision depends only on announcements that share a code, an address, enough title words, or
a title inside that of an update, so connected groups of such candidates are independent: the groups are found by
joins, and each runs the ordered pass on its own.  Announcements linked before seed the pass, so later ones can be linked alone.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict, namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.notices import role
from noticeworks.functions.text import editions_compatible, is_service_url, jaccard, similarity
from noticeworks.functions.titles import describes_call, title_parts
from noticeworks.operators.lineage import cut_lineage

# Scores from which titles may be, and surely are, of one call; below which one address is two calls'; of a call's
# title inside an update's; share of words in titles of one source.  Territories that hold others, and roles that can open a call.
DOUBT, SAME, UNLIKE, INSIDE, OWN_SOURCE = 0.6, 0.9, 0.2, 0.85, 0.8
WIDE, ALPINE, LOCAL_KINDS, RENEWALS = {"ITA", "UE"}, {"TAA", "TN", "BZ"}, ("camera", "comune", "provincia"), ("extension", "amendment")
#: Edges that one task joins into components (16 bytes each); more are joined by label passing.
SMALL_EDGES = 500_000
#: Titles that a task compares at once by the words they share; announcements of small groups that are decided together.
LISTED, TOGETHER = 50_000, 2_000
LINK_SCHEMA = "id long, call long, how string, doubt long, score double"


def ambiguous_urls(rows: DataFrame, least: int = 2) -> DataFrame:
    """Addresses that one source uses for several announcements: they name a list, not a call."""
    return rows.filter("url_key IS NOT NULL").groupBy("source", "url_key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def title_pairs(rows: DataFrame, least: float = DOUBT) -> DataFrame:
    """(a, b, score) with a < b of titles that share a word and are alike by at least ``least``.

    Candidates meet on the words of the smaller set: a score of ``least`` needs a common word among any
    floor((1 - least / 0.9) * size) + 1 of them, so each title is listed under that many of its rarest words; its
    partners list theirs too, and the larger title is listed under all.  Nothing above the threshold is lost.
    """
    words = rows.select("id", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(counts, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
    short = F.floor((1 - least / 0.9) * F.size("w") + 1e-9).cast("int") + 1
    rare = ranked.select("id", F.explode(F.transform(F.slice("w", 1, short), lambda x: x["word"])).alias("word"))
    sets = rows.select("id", "words", "years", "territory")
    pairs = rare.alias("x").join(words.alias("y"), (F.col("x.word") == F.col("y.word")) & (F.col("x.id") != F.col("y.id")))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    a = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("years").alias("ya"), F.col("territory").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("years").alias("yb"), F.col("territory").alias("tb"))
    near = (F.col("ta") == F.col("tb")) | F.col("ta").isin("ALL") | F.col("tb").isin("ALL")
    scored = pairs.join(a, "a").join(b, "b").filter(near & editions_compatible(F.col("ya"), F.col("yb")))
    return scored.select("a", "b", similarity(F.col("wa"), F.col("wb")).alias("score"), jaccard(F.col("wa"), F.col("wb")).alias("jaccard")).filter(F.col("score") >= least)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): by union-find in one task where edges are few, else by minimum labels with pointer jumping."""
    edges = cut_lineage(edges.select("a", "b").filter("a != b").distinct())
    if edges.count() <= SMALL_EDGES:
        return edges.coalesce(1).mapInPandas(_united, "node long, component long")
    both = cut_lineage(edges.union(edges.select("b", "a")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        up = step.select(F.col("node").alias("c"), F.col("c").alias("component"))
        step = cut_lineage(step.join(up, "c").select("node", "component", "old"))
        labels = step.select("node", "component")
        if not step.filter("component != old").limit(1).count():
            return labels


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            low, high = sorted((top(a), top(b)))
            up[high] = low
    yield pd.DataFrame([(x, top(x)) for x in up], columns=["node", "component"])


def prepared(rows: DataFrame, year: int) -> DataFrame:
    """Announcements (id, source, issuer, territory, urls, code, title, seen) with all that decisions look at."""
    issuer, title = F.coalesce("issuer", F.lit("")), F.coalesce("title", F.lit(""))
    urls = F.array_sort(F.array_distinct(F.filter("urls", lambda u: u.isNotNull() & ~is_service_url(u))))
    rows = rows.select(
        "id", "source", issuer.alias("issuer"), F.coalesce("territory", F.lit("")).alias("territory"), F.coalesce(urls, F.array().cast("array<string>")).alias("urls"), "code", "seen",
        title_parts(title, issuer).alias("parts"), role(title).alias("role"), title.alias("title_text"),
    )
    rows = rows.select("*", "parts.*", describes_call(F.col("title_text"), F.col("parts.words")).alias("whole")).drop("parts", "title_text")
    old = F.coalesce(F.array_max(F.transform("years", lambda y: y.cast("int"))) <= year - 2, F.lit(False))
    return rows.withColumn("archive", old)


def without_ambiguous(rows: DataFrame) -> DataFrame:
    """rows with only those urls that no source uses for several announcements."""
    one = rows.select("id", "source", F.explode("urls").alias("url_key"))
    bad = ambiguous_urls(one).select("url_key").distinct()
    good = one.join(bad, "url_key", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("url_key")).alias("good"))
    return rows.join(good, "id", "left").withColumn("urls", F.coalesce("good", F.array().cast("array<string>"))).drop("good")


def title_edges(titles: DataFrame) -> DataFrame:
    """(a, b) that connect what may be alike: titles (id, words, update) of a score of DOUBT, or of which one lies inside an update's, end up in one component.

    They meet on the rarest words of the smaller set (see ``title_pairs``; a contained title has its rarest word in the other, too), every
    title being listed under all of its words.  A list tests a title only against those that it is not yet connected with
    there, and gives one edge for each two parts that it joins: no pairs are made, and a group of copies costs about its size.
    Words are compared by 32 bits; two that agree by chance, and years, editions or places, can only make groups larger.
    """
    words = titles.select("id", "update", F.explode(F.transform("words", lambda x: F.hash(x))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(counts, "word").groupBy("id", "update").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
    ranked = ranked.select("id", "update", F.transform("w", lambda x: x["word"]).alias("words"), F.posexplode("w").alias("at", "w"))
    listed = ranked.select("id", "update", "words", "w.*", (F.col("at") < F.floor((1 - DOUBT / 0.9) * F.size("words") + 1e-9) + 1).alias("small")).filter("df > 1")
    parts = F.ceil(F.col("df") / LISTED).cast("int")  # of a long list; its smaller titles meet each
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    listed = listed.withColumn("part", F.explode(F.when(F.col("small"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own)))).withColumn("large", F.col("part") == own)
    listed = cut_lineage(listed.select("id", "update", "words", "word", "part", "small", "large"))
    lists = max(1, -(-listed.count() // LISTED))
    listed = listed.withColumn("list", F.pmod(F.xxhash64("word", "part"), F.lit(lists)))
    return listed.groupBy("list").applyInArrow(_connected, "a long, b long")


def _connected(group: pa.Table) -> pa.Table:
    """Edges that connect the alike titles of each word's list."""
    flat = group.column("words").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    ends = flat.offsets.to_numpy().astype(np.int64)
    numbers = np.unique(flat.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], return_inverse=True)[1]
    sizes = np.diff(ends)
    words = np.full((len(sizes), sizes.max(initial=1)), numbers.max(initial=0) + 1, np.int32)  # behind the last word stands one of no title
    words[np.arange(words.shape[1]) < sizes[:, None]] = numbers
    ids, word, part, small, large, update = (group.column(c).to_numpy() for c in ("id", "word", "part", "small", "large", "update"))
    mark = np.zeros(numbers.max(initial=0) + 2, np.int8)
    order = np.lexsort((part, word))
    new = np.flatnonzero((np.diff(word[order]) != 0) | (np.diff(part[order]) != 0)) + 1
    up: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for rows in np.split(order, new):
        left = rows[large[rows]]
        if not len(left) or len(rows) < 2:
            continue
        node = {int(r): k for k, r in enumerate(left)}
        of = np.arange(len(left))  # the part that each is connected with in this list
        for x in rows[small[rows]].tolist():
            mine = node.get(x)
            own = of[mine] if mine is not None else -1
            apart = np.flatnonzero((of != own) & (sizes[left] >= sizes[x]))
            if not len(apart):
                continue
            mark[words[x, : sizes[x]]] = 1
            near = left[apart]
            common = mark[words[near]].sum(1)
            mark[words[x, : sizes[x]]] = 0
            n, m = sizes[x], sizes[near]
            hit = common >= (DOUBT - 1e-9) * (n + m - common)
            if n >= 4:
                hit |= 0.9 * common >= (DOUBT - 1e-9) * n
            if n >= 2:
                hit |= update[near] & (common >= n)
            joined, first = np.unique(of[apart[hit]], return_index=True)
            if not len(joined):
                continue
            for y in near[hit][first].tolist():
                a, b = _top(up, int(ids[x])), _top(up, int(ids[y]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    edges.append((int(ids[x]), int(ids[y])))
            of[np.isin(of, joined)] = own if mine is not None else joined[0]
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _top(up: dict[int, int], x: int) -> int:
    """The root of x, whose way is halved."""
    while up.setdefault(x, x) != x:
        up[x] = x = up[up[x]]
    return x


PARTS = ["words", "years", "editions", "places"]
COLUMNS = ["id", "source", "issuer", "territory", "urls", "code", "role", "archive", "whole", "seen", "known", *PARTS, "title"]
Announcement = namedtuple("Announcement", COLUMNS)


def link_groups(rows: DataFrame, known: DataFrame | None = None, year: int = 2026) -> DataFrame:
    """id, call, how (code, url, title, new, doubt, ignore), doubt (a call it may belong to), score of the best title.

    rows: id (one each), source, issuer (``issuer_key``), territory, urls (``url_key`` of each address), code, title, seen
    (order of arrival).  known: the same columns and call, linked before; they come first and are not decided again.  A
    call is named by the announcement that opened it; call is null in doubt and for what is ignored: an update of a call
    of two years ago or more that is not known.  Nulls of any column tell nothing.  Equal titles are compared once,
    and a group knows a call by each different (title, source, issuer, territory, code) once.
    """
    first = [c for c in rows.columns if c in ("id", "source", "issuer", "territory", "urls", "code", "title", "seen")]
    every = rows.select(*first, F.lit(None).cast("long").alias("known"))
    if known is not None:
        every = every.unionByName(known.select(*first, F.col("call").cast("long").alias("known")))
    names = every.select("id", F.col("known"))
    every = cut_lineage(without_ambiguous(prepared(every.drop("known"), year)).join(names, "id"))
    titles = every.groupBy(*PARTS).agg(F.min("id").alias("title"), F.max(F.col("role").isNotNull()).alias("update"))
    every = cut_lineage(every.join(titles.drop("update"), PARTS))
    alike = title_edges(titles.withColumnRenamed("title", "id"))
    star = lambda key, of: of.join(of.groupBy(key).agg(F.min("id").alias("a")), key).select("a", F.col("id").alias("b"))
    by_url = every.select("id", F.explode("urls").alias("url"))
    same = every.filter(F.size("words") > 0).select(F.col("title").alias("a"), F.col("id").alias("b"))
    of_call = star("known", every.filter("known IS NOT NULL"))  # what is linked already goes together
    edges = star("code", every.filter("code IS NOT NULL")).union(star("url", by_url)).union(same).union(of_call).union(alike)
    labels = cut_lineage(components(edges))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    several = max(1, -(-(sizes.filter(F.col("n") < TOGETHER).agg(F.sum("n")).first()[0] or 0) // TOGETHER))
    group_no = F.when(F.col("n") < TOGETHER, -1 - F.pmod(F.xxhash64("component"), F.lit(several))).otherwise(F.col("component"))  # ids of rows may be negative, too: two groups in one are no fault
    grouped = every.join(labels.join(sizes, "component"), every.id == F.col("node")).select(group_no.alias("group_no"), *COLUMNS)
    linked = grouped.groupBy("group_no").applyInArrow(_ordered_pass, LINK_SCHEMA)
    alone = every.join(labels, every.id == F.col("node"), "left_anti").filter("known IS NULL")
    how = F.when(F.col("role").isNull(), "new").when(F.col("archive"), "ignore").when(F.col("role").isin(*RENEWALS) & F.col("whole"), "new").otherwise("doubt")
    alone = alone.select("id", F.when(how == "new", F.col("id")).alias("call"), how.alias("how"), F.lit(None).cast("long").alias("doubt"), F.lit(None).cast("double").alias("score"))
    return linked.unionByName(alone)


class Titles:
    """The different titles of a group: their words as numbers, rarest first, and their other parts."""

    def __init__(self, rows: list[Announcement]):
        first = {r.title: r for r in rows}
        df = Counter(w for r in first.values() for w in r.words)
        number = {w: k for k, w in enumerate(sorted(df, key=lambda w: (df[w], w)))}
        self.number = {title: k for k, title in enumerate(first)}
        self.sizes = np.array([len(r.words) for r in first.values()], np.int64)
        self.words = np.full((len(first), max(1, self.sizes.max(initial=1))), len(number), np.int32)
        for k, r in enumerate(first.values()):
            self.words[k, : len(r.words)] = sorted(number[w] for w in r.words)
        self.parts = [tuple(frozenset(x) for x in (r.years, r.editions, r.places)) for r in first.values()]
        self.mark = np.zeros(len(number) + 1, np.int8)

    def rare(self, k: int) -> list[int]:
        """So many of the rarest words that one is common with each larger title that is alike by DOUBT."""
        return self.words[k, : int((1 - DOUBT / 0.9) * self.sizes[k] + 1e-9) + 1].tolist() if self.sizes[k] else []

    def common(self, k: int, others: np.ndarray) -> np.ndarray:
        mine = self.words[k, : self.sizes[k]]
        self.mark[mine] = 1
        out = self.mark[self.words[others]].sum(1, dtype=np.int64)
        self.mark[mine] = 0
        return out

    def alike(self, k: int, others: np.ndarray, update: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and shares of common words; an update's title scores INSIDE at least for those that lie in it."""
        common, n, m = self.common(k, others), self.sizes[k], self.sizes[others]
        small = np.minimum(n, m)
        share = common / np.maximum(n + m - common, 1)
        score = np.maximum(share, np.where(small >= 4, 0.9 * common / np.maximum(small, 1), 0.0))
        return np.where((m >= 2) & (common == m), np.maximum(score, INSIDE), score) if update else score, share

    def fit(self, k: int, other: int) -> bool:
        """Years of one within the other's, the same editions, a common place, where both have some."""
        (years, editions, places), (years_2, editions_2, places_2) = self.parts[k], self.parts[other]
        if years and years_2 and not (years <= years_2 or years_2 <= years):
            return False
        return (not editions or not editions_2 or editions == editions_2) and (not places or not places_2 or not places.isdisjoint(places_2))


class Known:
    """The calls of a group as its announcements make them known, in their order; titles that are known are found by their words."""

    def __init__(self, titles: Titles):
        self.all = titles
        self.codes: dict[str, int] = {}
        self.urls: dict[str, int] = {}
        self.order: dict[int, int] = {}
        self.titles: dict[int, list[int]] = defaultdict(list)
        #: Of each title: what it is known of (source, issuer, territory, code, call), in order of arrival.
        self.of_title: dict[int, dict[tuple, int]] = defaultdict(dict)
        self.added = 0
        #: Known titles by each of their words, and by their rare ones.
        self.by_word: dict[int, array] = defaultdict(lambda: array("q"))
        self.by_rare: dict[int, array] = defaultdict(lambda: array("q"))
        self.found = np.zeros(len(titles.sizes), bool)

    def add(self, r, call: int) -> None:
        self.order.setdefault(call, len(self.order))
        if r.code is not None:
            self.codes.setdefault(r.code, call)
        for url in r.urls:
            self.urls.setdefault(url, call)
        k = self.all.number[r.title]
        if k not in self.of_title:
            for word in self.all.words[k, : self.all.sizes[k]].tolist():
                self.by_word[word].append(k)
            for word in self.all.rare(k):
                self.by_rare[word].append(k)
            self.titles[call].append(k)
        elif k not in self.titles[call]:
            self.titles[call].append(k)
        self.of_title[k].setdefault((r.source, r.issuer, r.territory, r.code, call), self.added)
        self.added += 1

    def candidates(self, k: int) -> np.ndarray:
        """Known titles that may be alike: larger ones by the rare words of this one, smaller ones by theirs."""
        lists = [self.by_word[w] for w in self.all.rare(k) if w in self.by_word]
        lists += [self.by_rare[w] for w in self.all.words[k, : self.all.sizes[k]].tolist() if w in self.by_rare]
        for x in lists:
            self.found[np.frombuffer(x, np.int64)] = True
        out = np.flatnonzero(self.found) if lists else np.zeros(0, np.int64)
        self.found[out] = False
        return out

    def best(self, r):
        """The best title for r: score, call, Jaccard, source and issuer, and its number; of equals the oldest call's first."""
        mine = self.all.number[r.title]
        others = self.candidates(mine)
        if not len(others):
            return None
        scores, shares = self.all.alike(mine, others, r.role is not None)
        order = np.flatnonzero(scores >= DOUBT)
        order = order[np.argsort(-scores[order])]
        found = None
        for title, score, share in zip(others[order].tolist(), scores[order].tolist(), shares[order].tolist(), strict=True):
            if found is not None and score < found[1]:
                break
            if not self.all.fit(mine, title):
                continue
            for (source, issuer, territory, code, call), at in self.of_title[title].items():
                if not _near(r.territory, territory) or (r.code is not None and code is not None and r.code != code):
                    continue
                if (_rivals(r.issuer, issuer) and share < SAME) or (source == r.source and share < OWN_SOURCE and r.role is None):
                    continue
                key = (-score, self.order[call], at)
                if found is None or key < found[0]:
                    found = key, score, call, share, source, issuer, title
        return found

    def decide(self, r) -> tuple[str, int | None, float | None]:
        """how, the call or the one in doubt, and the score."""
        if r.code in self.codes:
            return "code", self.codes[r.code], None
        for url in r.urls:
            if url in self.urls:
                call = self.urls[url]
                score = float(self.all.alike(self.all.number[r.title], np.array(self.titles[call]), False)[0].max())
                return ("doubt" if score < UNLIKE else "url"), call, score
        best = self.best(r)
        if best is not None and best[1] >= DOUBT:
            _, score, call, share, source, issuer, title = best
            (years, editions, _), (my_years, my_editions, _) = self.all.parts[title], self.all.parts[self.all.number[r.title]]
            dated = my_years or my_editions or source == r.source
            if share >= SAME and issuer == r.issuer and (years, editions) == (my_years, my_editions) and dated:
                return "title", call, score
            return ("new", None, score) if r.archive else ("doubt", call, score)
        if r.role is None or (not r.archive and r.role in RENEWALS and r.whole):
            return "new", None, None
        return ("ignore" if r.archive else "doubt"), None, None


def _rows(group: pa.Table) -> list[Announcement]:
    """A group in order: what is known first, then by arrival."""
    rows = [Announcement(*values) for values in zip(*(group.column(c).to_pylist() for c in COLUMNS), strict=True)]
    return sorted(rows, key=lambda r: (r.known is None, r.seen is None, r.seen or 0, r.id))


def _ordered_pass(group: pa.Table) -> pa.Table:
    rows, out = _rows(group), []
    calls = Known(Titles(rows))
    for r in rows:
        if r.known is not None:
            calls.add(r, int(r.known))
            continue
        how, call, score = calls.decide(r)
        if how == "new":
            call = r.id
        if how not in ("doubt", "ignore"):
            calls.add(r, call)
        out.append((r.id, None if how in ("doubt", "ignore") else call, how, call if how == "doubt" else None, score))
    columns = zip(["id", "call", "how", "doubt", "score"], zip(*out) if out else ((),) * 5, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()], strict=True)
    return pa.table({name: pa.array(values, kind) for name, values, kind in columns})


def _near(a: str, b: str) -> bool:
    return a == b or not WIDE.isdisjoint((a, b)) or {a, b} <= ALPINE


def _rivals(a: str, b: str) -> bool:
    """Two authorities of one kind with other names."""
    kind = a.split(" ")[0]
    return kind in LOCAL_KINDS and kind == b.split(" ")[0] and a != b


def _alike(a: frozenset, b: frozenset) -> float:
    if not a or not b:
        return 0.0
    common, small = len(a & b), min(len(a), len(b))
    return max(common / len(a | b), 0.9 * common / small if small >= 4 else 0.0)
