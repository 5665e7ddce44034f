import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticeworks.llm import bpe, packing, token_counts
from noticeworks.llm.common import fresh_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


ENCODER = bpe.encoder(bpe.default_vocabulary())
LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeithns '.\n", max_size=80) | st.text(alphabet="aé日 ", max_size=40))
def test_encoder_equals_library(text):
    ids = np.frombuffer(ENCODER.encode_bytes(text), "<u4").astype(np.int64)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_encode_decode(docs, rows, library):
    got = Counter(tuple(r) for r in bpe.encode_decode(docs.withColumn("n_tokens", F.lit("clash")), bpe.default_vocabulary()).collect())
    want = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want[doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want


def test_token_ids_and_empty_table(docs, rows, none, library):
    got = {r.doc_id: r.ids for r in bpe.token_ids(docs.filter("doc_id IS NOT NULL"), bpe.default_vocabulary()).collect()}
    assert got == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in rows if d is not None}
    assert bpe.encode_decode(none, bpe.default_vocabulary()).collect() == []
    assert packing.pack_documents(none, bpe.default_vocabulary()).collect() == []


def test_packing_places_every_id_once(docs, rows, library):
    window = 64
    got = packing.pack_documents(docs.filter("doc_id IS NOT NULL").withColumn("start", F.lit(1)), bpe.default_vocabulary(), window=window).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in rows:
        if doc_id is None:
            continue
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    short = sum(sum(r.length for r in p) < window for p in by_seq.values())
    assert short <= 4  # one for each task at most


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 33))
def test_pack(lengths, window):
    windows = packing.pack(lengths, window)
    assert sorted((d, s + i) for w in windows for d, s, n in w for i in range(n)) == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    sizes = [sum(n for _, _, n in w) for w in windows]
    assert all(0 < s <= window for s in sizes) and sum(s < window for s in sizes) <= 1


def test_tightest_window():
    r = random.Random(5)
    for window in (1, 2, 7, 64):
        tree, have = packing.OpenWindows(window), []
        for number in range(200):
            if have and r.random() < 0.4:
                need = r.randint(0, window)
                fits = [c for c in have if c >= need]
                assert tree.tightest(need) == (min(fits) if fits else None)
                if fits:
                    tree.take(min(fits))
                    have.remove(min(fits))
            else:
                c = r.randint(0, window)
                tree.add(c, number)
                have.append(c)


def test_rollup(spark):
    roll = token_counts.Rollup(spark, fresh_path(spark, "rollup-test"))
    schema = "sign int, source string, lang string, version string, n_tokens long"
    first = [(1, "a", "en", "1", 10), (1, "a", "en", "1", 5), (1, None, "de", "1", 7), (1, "b", "en", "1", None), (None, "b", "en", "1", 3)]
    assert roll.apply("x", spark.createDataFrame(first, schema))
    assert not roll.apply("x", spark.createDataFrame(first, schema))
    assert roll.apply("y", spark.createDataFrame([(-1, "a", "en", "1", 5), (1, "a", "en", "1", 6), (-1, None, "de", "1", 7)], schema))
    assert roll.apply("z", spark.createDataFrame([], schema))
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "1", 2, 16)]


def test_token_counts_query(spark, docs, rows, library, tmp_path):
    named = docs.withColumn("source", F.when(F.col("doc_id") > 25, "s").otherwise("t")).withColumn("lang", F.lit("en"))
    named.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.version): (r.n_docs, r.n_tokens) for r in token_counts.op9_token_counts(spark, str(tmp_path)).collect()}
    want = Counter(), Counter()
    for doc_id, text in rows:
        source = "s" if (doc_id or 0) > 25 else "t"
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        if n:
            want[0][source, "1"] += 1
            want[1][source, "1"] += n
        want[0][source, "2"] += 1
        want[1][source, "2"] += n + max(1, -(-n // 1024))
    assert got == {k: (want[0][k], want[1][k]) for k in want[0]}
