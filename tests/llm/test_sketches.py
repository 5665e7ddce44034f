"""Sketches merge like sets; fingerprints and likeness at the scale in use against plain Python; long texts, repeated ids."""

from pyspark.sql import functions as F

from noticeworks.llm import fingerprints

from .conftest import prose


def test_merge_is_the_sketch_of_the_union(spark):
    sets = [[], [5], [-(1 << 63), 7], [(1 << 63) - 1], [(1 << 62), (1 << 62) + 1], list(range(-(1 << 63), -(1 << 63) + 9)), [3, -9]]
    rows = [(a, b) for a in sets for b in sets]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    s = fingerprints.sketch
    out = df.select(fingerprints.merged(s(F.col("a")), s(F.col("b"))).alias("m"), s(F.array_union("a", "b")).alias("u"), fingerprints.containment(s(F.col("a")), fingerprints.merged(s(F.col("a")), s(F.col("b")))).alias("c"), "a")
    for r in out.collect():
        assert r.m == r.u and (not r.a or r.c in (0.0, 1.0) or r.c > 0)


def hashes_of(spark, texts):
    """All shingle hashes of each text: the sketch at scale 1."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: set(r.k) for r in fingerprints.with_sketch(df, "text", "k", 1).collect()}


def kept(hashes, scale=fingerprints.SCALE):
    below = {h for h in hashes if h < -(1 << 63) + (1 << 64) // scale}
    return below or ({min(hashes)} if hashes else set())


def test_likeness_at_the_scale_in_use(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    more = [*[(d, t or "") for d, t in rows if d is not None], *((200, prose(200 + i, 30)) for i in range(9)), (300, "a b c d e f " * 60_000)]
    out = fingerprints.edited_likeness(spark.createDataFrame(more, "doc_id long, text string").withColumns({"bucket": F.lit(1), "copy": F.lit(2)})).collect()
    assert len(out) == len(more)
    known = sorted(more, key=lambda r: r[1])
    known.sort(key=lambda r: -r[0])
    following = {k: known[(i + 1) % len(known)][1] for i, k in enumerate(known)}
    edits = {k: k[1][: len(k[1]) - len(k[1]) // 2] + following[k][: len(k[1]) // 2] for k in known}
    texts = [*known]
    h = hashes_of(spark, [t for k in texts for t in (k[1], edits[k], following[k])])
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    text_of = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in sorted(s))
    want = []
    for i, k in enumerate(texts):
        a, b, c = (kept(h[3 * i + j]) for j in range(3))
        want.append((k[0], len(k[1]), text_of(a), text_of(b), round(share(a, b), 9), round(share(a, c), 9), round(len(a & b) / len(a) if a else 1.0, 9)))
    got = [(r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), round(r.contained_in_edited, 9)) for r in out]
    assert sorted(got) == sorted(want)
