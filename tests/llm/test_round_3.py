"""Operators 11 to 13 against plain Python, on odd rows and on data that make every branch run."""

import io
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from noticeworks.llm import ball_trees, filter_audit, hard_negatives, token_counts, token_files
from noticeworks.llm.common import fresh_path

from .conftest import prose

VOCABULARY = token_files.default_vocabulary()
ODD = [
    "It's <|startoftext|>they'LL go <|endoftext|>", "ÀÉÎõü ŒUVRE straße ǅ ẞ", "İstanbul ıI", "ΣΑΣ ος ΟΔΥΣΣΕΥΣ", "é café NAÏVE", "a\x1cb\x1fc d e f",
    "x² ½ 日本語 🙂👍🏽", "12345 1,234.56 '' ''s 's't", "ﬁ Å ẛ̣", "  \n\t ", "_a_b__ -- ... !?'re", "ªº×÷ª", "Ǆ ǆ Ⱥ ɏ", "a" * 5000, "'" * 300, "\x00\x07z",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


# --- 11 ----------------------------------------------------------------------------------------------------------


def test_words_are_encoded_as_whole_texts(library):
    r, enc = random.Random(1), token_files.WordEncoder(VOCABULARY)
    letters = "abcXYZ 019'’éÀßøÿ-_.<|>\n\t́日İ²"
    texts = [*ODD, *("".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(3000)), *(prose(i, 50) for i in range(20))]
    for text in texts * 2:  # the second time from the table of words
        assert enc.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def stream(docs, width=2):
    out = io.BytesIO()
    writer = token_files.Writer(out, width)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, f"<u{width}").tobytes())
    writer.close()
    return out.getvalue()


def gathered(pieces):
    out = []
    for p in pieces:
        if p.start == 0:
            out.append((p.doc_id, []))
        out[-1][1].extend(p.ids.tolist())
    return out


@pytest.mark.parametrize("width", [2, 4])
def test_file_round_trip_and_seeking(monkeypatch, width):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    r = random.Random(2)
    docs = [(None, [7] * 250), (None, [])] + [(i, [r.randrange(60_000) for _ in range(r.choice((0, 1, 30, 99, 100, 101, 450)))]) for i in (-5, 0, 3, 3, 4, 10, 11, 12, 500)]
    raw = stream(docs, width)
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    assert gathered(reader.all()) == docs and all(f.ids <= 100 for f in reader.frames)
    for wanted in ([3], [10, 500], [-5], [99], []):
        reader = token_files.Reader(io.BytesIO(raw), len(raw))
        assert gathered(reader.wanted(wanted)) == [d for d in docs if d[0] in wanted]
        assert reader.frames_read < len(reader.frames)
    # any zstandard reader unpacks the frames one after another and skips the table
    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) == sum(f.raw for f in reader.frames)
    assert gathered(token_files.Reader(io.BytesIO(stream([])), len(stream([]))).all()) == []


def test_damage_is_found():
    raw = bytearray(stream([(i, [i] * 50) for i in range(20)]))
    for at in (20, len(raw) - token_files.FOOTER.size - 10, len(raw) - 3):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(token_files.Reader(io.BytesIO(bad), len(bad)).all())


def brute_token_rows(rows, library):
    out, at = [], 0
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    for d, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


def test_token_files_of_a_corpus(spark, docs, rows, none, library, monkeypatch):
    odd = rows + [(200 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(odd, "doc_id long, text string").repartition(5).withColumn("raw", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    folder = fresh_path(spark, "test-tokens")
    files = token_files.write_corpus(frame, VOCABULARY, folder)
    got = sorted((tuple(r)[:4] for r in token_files.read_documents(files, folder).collect()), key=lambda r: r[1])
    want = brute_token_rows(odd, library)
    named = [r for r in want if r[0] is not None]
    assert [r for r in got if r[0] is not None] == named
    # rows without an id come first, in any order
    assert Counter(r[2:] for r in got) == Counter(r[2:] for r in want) and [r[0] for r in got] == [r[0] for r in want]
    some = token_files.read_documents(files, folder, [80, 90, 12345]).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in some} == {(r[0], *r[2:]) for r in named if r[0] in (80, 90)}
    empty = token_files.write_corpus(none, VOCABULARY, fresh_path(spark, "test-tokens"))
    assert empty.count() == 0 and token_files.read_documents(empty, folder).count() == 0


def test_repeated_ids_and_many_files(spark, monkeypatch, library):
    rows = [(5, "one two")] * 40 + [(5, None)] * 3 + [(1, "x"), (9, "y z")]
    folder = fresh_path(spark, "test-tokens")
    files = token_files.write_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), VOCABULARY, folder)
    got = sorted((tuple(r)[:4] for r in token_files.read_documents(files, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r[0] for r in rows) and Counter(r[2] for r in got) == Counter({3: 41, 1: 3, 2: 1})
    assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got)][:-1]


# --- 12 ----------------------------------------------------------------------------------------------------------

LABELLED = "vec_id long, embedding array<double>, label int"


def brute_negatives(rows, positives=5, negatives=3):
    clean = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in sorted(clean, key=lambda r: (r[1], r[2]), reverse=True):
        if i % 50 == 0:
            anchors[i] = v, label
    out = Counter()
    for q, (a, label) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, other) for i, v, other in clean if i != q and len(v) == len(a))
        for low, p, _ in [r for r in scored if r[2] == label][:positives]:
            hits = [(-s, n) for s, n, other in scored if other != label and 50 * -low <= 100 * -s <= 95 * -low][:negatives]
            out.update((q, p, rank, n, -low, s) for rank, (s, n) in enumerate(hits, 1))
    return out


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_negatives_of_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) + (i % 3 == k) for k in range(4)], i % 3) for i in range(160)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [1.0] * 4, None), (None, [1.0] * 4, 1), (250, [float("inf")] * 4, 1)]
    rows += [(300, [], 0), (301, [], 0), (302, [], 1), (303, [], 2), (350, [1.0], 1), (350, [1.0], 1), (350, [2.0], 0), (351, [1.0], 1), (352, [0.7], 2), (353, [0.0], 0)]
    rows += [(400, [3e5 + 1] * 9, 1), (401, [3e5 + 2] * 9, 1), (402, [2e5 + 1] * 9, 0), (403, [2.8e5] * 9, 0), (404, [1e5] * 9, 0)]
    frame = spark.createDataFrame(rows, LABELLED).repartition(3).withColumn("cell", F.lit("clash")).withColumn("v", F.lit(1))
    assert counted(hard_negatives.mined(frame, "vec_id % 50 = 0")) == brute_negatives(rows)
    assert hard_negatives.mined(frame.limit(0), "vec_id % 50 = 0").count() == 0


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_negatives_through_cells_sub_cells_and_deals(spark, monkeypatch, spread):
    """Small shards, so that labels and cells are dealt on; hot equal vectors of many labels, several waves and blocks."""
    for name, value in (("SHARD_ROWS", 60), ("CELL_ROWS", 100), ("BLOCK_QUERIES", 3), ("WAVES", (1, 3)), ("BROADCAST_ROWS", 2)):
        monkeypatch.setattr(ball_trees, name, value)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 8)) + 0.3
    of = rng.integers(0, 12, 800)
    rows = [(i, (centre[k] + spread * rng.normal(size=8)).tolist(), int(k % 5) if rng.random() < 0.8 else int(rng.integers(0, 40))) for i, k in enumerate(of)]
    rows += [(1000 + i, [0.5] * 8, i % 3) for i in range(400)]
    frame = spark.createDataFrame(rows, LABELLED).repartition(3)
    assert counted(hard_negatives.mined(frame, "vec_id % 50 = 0")) == brute_negatives(rows)
    clean = ball_trees.clean(frame, "vec_id", "embedding", 256, "label")
    centres = ball_trees.centres_of(clean)
    shards = ball_trees.Shards(ball_trees.with_cells(clean, centres).withColumn("grp", F.lit(0).cast("long")), centres, 3)
    sizes = shards.sizes.collect()
    assert len(centres[8]) > 4 and shards.inner is not None and max(r["sub"] for r in sizes) > 1 and max(r.deals for r in sizes) > 1


# --- 13 ----------------------------------------------------------------------------------------------------------


def fails(rows):
    """Per row: part, doc_id and the letters it fails."""
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = ("A" if len(words) < 50 else "") + ("B" if 100 * len(set(words)) < 65 * len(words) else "") + ("C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else "")
        out += ("D" if re.search(r"[#$%&*|]", text) else "") + ("E" if d is not None and d > first[text] else "")
        yield source or "", d, out


def brute_audit(rows, labels):
    named = [x for x in labels if x[0] is not None]  # a label without an id is no document's
    good, toxic = {d for d, q, _ in named if q == 1}, {d for d, _, t in named if t == 1}
    docs, out = list(fails(rows)), set()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for p, _, _ in docs}:
        mine = [(d, f) for p, d, f in docs if p == part]
        shapley, lines = Counter(), []
        for order in orders:
            left = mine
            for step, x in enumerate(order, 1):
                gone, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                failing = sum(x in f for _, f in mine)
                lines.append((x, (part, order, step, len(stay), len(gone), failing - len(gone), sum(f == x for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))))
                shapley[x] += len(gone)
                left = stay
        out |= {(*line, shapley[x]) for x, line in lines}
    return out


def test_filter_audit_of_odd_rows(spark):
    r = random.Random(8)
    rows = [(i, prose(i, r.choice((3, 49, 50, 51, 60, 120))) + r.choice(("", "", " #", " ABCDEFGHIJ KLMNOPQRSTUVWXYZ" * 3, " x y\x0b\x0cz")), r.choice(("a", "b", None, ""))) for i in range(150)]
    rows += [(500 + i, rows[i % 7][1], r.choice(("a", "b"))) for i in range(60)] + [(3, rows[3][1], "a"), (3, rows[3][1], "b"), (510, "other", "a"), (510, "other", "c")]
    rows += [(None, rows[1][1], "a"), (None, None, None), (None, "only", "c"), (None, "only", "c"), (700, None, "a"), (701, "", "a"), (702, "é" * 30 + "AB", "c"), (703, "x " * 40_000, "c")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(0, 700, 2)] + [(4, 1, 0), (4, 1, 0), (None, 1, 1), (99999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("mask", F.lit("clash")).withColumn("good", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audited(filter_audit.cells(docs, marks), "ABCDE").collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert filter_audit.audited(filter_audit.cells(docs.limit(0), marks), "ABCDE").count() == 0
    assert {(x.part, x.mask, x.n) for x in filter_audit.cells(docs, marks.limit(0), {"X": F.col("doc_id") % 2 == 0}, F.lit(None)).collect()} == {
        ("", 0 + 2 * e + odd, n) for (odd, e), n in Counter((int(d is not None and d % 2 == 0), int("E" in f)) for _, d, f in fails(rows)).items()
    }


# --- 9: several writers ------------------------------------------------------------------------------------------


def meanwhile(roll, do):
    """Before roll's next entry is made, do() runs to its end."""
    own, todo = roll.commit, [do]

    def commit(*args, **kwargs):
        if todo:
            todo.pop()()
        return own(*args, **kwargs)

    roll.commit = commit


def changed(spark, *rows):
    return spark.createDataFrame([(s, d, "src", "en", "1", n) for s, d, n in rows], "sign int, doc_id long, source string, lang string, version string, n_tokens long")


def sums(roll):
    return {(r.n_docs, r.n_tokens) for r in roll.totals().collect()}, {(r.doc_id, r.n_tokens, r.sign) for r in roll.documents().collect()}


@pytest.mark.parametrize("first", ["batch", "compaction"])
def test_a_batch_beside_a_compaction(spark, first):
    folder = fresh_path(spark, "writers")
    one, two = token_counts.Rollup(spark, folder), token_counts.Rollup(spark, folder)
    assert one.apply("a", changed(spark, (1, 1, 10)))
    batch = lambda roll: roll.apply("b", changed(spark, (1, 2, 5)))
    if first == "batch":
        meanwhile(one, lambda: batch(two))
        assert one.compact()
    else:
        meanwhile(one, two.compact)
        assert batch(one)
    want = {(2, 15)}, {(1, 10, 1), (2, 5, 1)}
    assert sums(one) == sums(two) == want
    assert two.compact() and sums(one) == want
    # a compaction that saw less than an earlier one
    meanwhile(one, two.compact)
    assert one.compact() and sums(two) == want and not one.apply("b", changed(spark, (1, 9, 9)))


@pytest.mark.parametrize("same", [True, False])
def test_two_batches_that_delete_one_document(spark, same):
    folder = fresh_path(spark, "writers")
    one, two = token_counts.Rollup(spark, folder), token_counts.Rollup(spark, folder)
    one.apply("a", changed(spark, (1, 1, 10), (1, 2, 5)))
    gone = changed(spark, (-1, 1, 10))
    meanwhile(one, lambda: two.apply("x", gone))
    assert one.apply("x" if same else "y", gone) == (not same)
    assert sums(one) == ({(1, 5)}, {(2, 5, 1)})
    assert [(r.doc_id, r.sign) for r in one.refused().collect()] == ([] if same else [(1, -1)])


def test_entries_are_made_once(spark):
    path = fresh_path(spark, "log") + "/000000000001.json"
    assert token_counts.put_if_absent(spark, path, "one") and not token_counts.put_if_absent(spark, path, "two")
    assert [r.value for r in spark.read.text(path).collect()] == ["one"]
