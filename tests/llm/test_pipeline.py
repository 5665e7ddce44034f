"""The stages in order over the smallest tables: columns, ids, and near duplicates against brute force."""

import collections

import corpus_pipeline

TABLES = "/root/testdata/sf0.001"


def bag(text):
    words = text.lower().split()
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return collections.Counter(grams)


def first_of_classes(texts):
    """Smallest id of each class of texts linked by a multiset overlap of 0.8 or more; empty texts are copies."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: bag(t) for i, t in texts.items()}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if both >= 0.8 * either - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, TABLES).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept and kept <= set(before)
        if name == "near_dups":
            assert kept == first_of_classes(before)
        if name in ("passages", "pii", "packing"):
            assert kept == set(before)
        if name != "packing":
            assert docs.columns == columns
