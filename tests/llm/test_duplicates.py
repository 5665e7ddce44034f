import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import fingerprints, near_dups, passages

from .conftest import edited, prose


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    ids = [d for d, _ in rows if d is not None]
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, bag(t)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            both = (x & y).total()
            if both >= 0.8 * (x.total() + y.total() - both) - 1e-9:
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: top(d) for d in ids}


def test_near_classes(docs, rows):
    got = near_dups.near_classes(docs.withColumn("class_id", F.lit(1))).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute_classes(rows)
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]


def test_near_classes_chain_and_counts(spark):
    """A chain whose ends are unlike, a large group of variants, and bags that differ in counts only."""
    chain = [prose(7, 300)]
    for i in range(8):
        chain.append(edited(chain[-1], 100 + i, 4))
    group = [edited(prose(8, 250), i, 3) for i in range(40)]
    counted = ["x1 x2 x3 x4 x5 " * n for n in (3, 30, 31, 36)]
    rows = list(enumerate(chain + group + counted + [prose(500 + i, 60) for i in range(30)]))
    want = brute_classes(rows)
    got = near_dups.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_near_repeated_ids_empty_and_keep(spark, none, docs, rows):
    assert near_dups.near_classes(none).collect() == []
    twice = spark.createDataFrame([(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(2, 50)), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_classes(twice).collect()}
    assert got[3] == 3 and got[1] == 1 and set(got) == {1, 2, 3}
    kept = near_dups.keep_first(docs.withColumn("node", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "node"]
    classes = brute_classes(rows)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(classes.values()))


def test_bag_min_hash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 120).astype(np.uint64)
    a, b = rng.integers(1, 20, 120), rng.integers(1, 20, 120)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    docs = np.repeat([0, 1], 120)
    signs = near_dups.bag_min_hash(docs, np.r_[hashes, hashes], np.r_[a, b], 2, 4000)
    assert abs((signs[0] == signs[1]).mean() - want) < 0.03


def brute_removed(rows, length=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], 1 << 63 if d is None else d)
    out = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (1 << 63 if d is None else d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, len(raw), sum(gone), spans, kept] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 21])
def test_remove_repeats(docs, rows, block_bytes):
    out = passages.remove_repeats(docs.withColumn("Kept", F.lit(1)).withColumn("block", F.lit("b")), block_bytes=block_bytes)
    assert out.columns == ["doc_id", "text", "block", "n_bytes", "n_removed", "n_spans", "kept"]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == brute_removed(rows)


def test_remove_repeats_other_length_and_periodic_texts(spark):
    rows = [(i, t) for i, t in enumerate(["ab" * 60, "ba" * 45, "x" + "ab" * 20 + "y", "é" * 40, "zé" + "é" * 30, prose(1, 30), prose(1, 30)[7:90], prose(1, 30)])]
    rows += [(3, "ab" * 30), (3, prose(1, 30))]
    for length in (8, 50):
        out = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, block_bytes=200)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == brute_removed(rows, length)


def test_stretches_do_not_matter():
    import pyarrow as pa

    text = [prose(4, 900), prose(5, 40), "", prose(4, 900)[50:]]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, 4], pa.int64()), "text": text})
    (block,) = list(passages.to_blocks(iter([batch])))
    whole = passages.Block(block.column(2)[0].as_py())
    a, b = passages.Sample(whole, 50), passages.Sample(whole, 50, stretch=101)
    windows = lambda s: sorted((int(f) + k, int(p)) for f, n, p in zip(s.first, s.count, s.anchor) for k in range(n))
    assert windows(a) == windows(b)


def test_remove_repeats_empty(none):
    assert passages.remove_repeats(none).collect() == []


def words(text):
    w = re.findall(r"[^ \t\n\x0b\f\r]+", (text or "").lower())  # what Java calls white space
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else ({tuple(w)} if w else set())


def test_edited_likeness(docs, rows, none):
    full = fingerprints.edited_likeness(docs.withColumn("kept", F.lit(1)), scale=1).collect()
    known = sorted(((d, t or "") for d, t in rows if d is not None), reverse=True)
    following = {known[i][0]: known[(i + 1) % len(known)][1] for i in range(len(known))}
    texts = dict(known)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(full) == len(rows)
    for r in full:
        if r.doc_id is None:
            continue
        text, other = texts[r.doc_id], following[r.doc_id]
        half = len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(words(text), words(edit)))
        assert r.near_next == pytest.approx(jaccard(words(text), words(other)))
    assert fingerprints.edited_likeness(none).collect() == []


def test_sketches(docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    few = {r.doc_id: r for r in fingerprints.edited_likeness(docs.filter("doc_id IS NOT NULL")).collect()}
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 1000)
    one = {r.doc_id: r for r in fingerprints.edited_likeness(docs.filter("doc_id IS NOT NULL")).collect()}
    assert few == one
    by_text = defaultdict(set)
    for d, t in rows:
        if d is not None:
            by_text[t or ""].add(few[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert few[90].fingerprint and len(few[90].fingerprint) / 16 == pytest.approx(5996 / 8, rel=0.2)
    both = docs.filter("doc_id IN (22, 90)")
    a, b = fingerprints.with_sketch(both.filter("doc_id = 90"), "text", "k").first().k, fingerprints.with_sketch(both.filter("doc_id = 22"), "text", "k").first().k
    assert a == sorted(a) and len(b) == 1
