"""Token ledger and compaction, words of any length, packing against a naive packer, rules in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeworks.llm import bpe, common, packing, quality, token_counts
from noticeworks.llm.common import fresh_path

from .conftest import prose

ENCODER, LIBRARY = bpe.encoder(bpe.default_vocabulary()), packing.encoder(bpe.default_vocabulary())
CHANGES = "sign int, doc_id long, source string, lang string, version string, n_tokens long"


def test_ledger_refuses_what_is_not_there(spark):
    roll = token_counts.Rollup(spark, fresh_path(spark, "ledger-test"))
    frame = lambda *rows: spark.createDataFrame(list(rows), CHANGES).withColumn("parts", F.lit("clash"))
    assert roll.apply("a", frame((1, 1, "s", "en", "1", 10), (1, 2, "s", "en", "1", 5), (1, 2, "s", "en", "1", 5), (1, None, None, None, "1", 7), (1, 3, "s", None, "1", 4)))
    assert not roll.apply("a", frame((1, 1, "s", "en", "1", 10)))
    assert roll.compact()
    # a good revision, a revision of an outdated count, deletes of an unknown document and of one of two copies
    assert roll.apply("b", frame(
        (-1, 1, "s", "en", "1", 10), (1, 1, "s", "en", "1", 12), (-1, 3, "s", None, "1", 5), (1, 3, "s", None, "1", 6), (-1, 9, "s", "en", "1", 1), (-1, 2, "s", "en", "1", 5), (-1, None, None, None, "1", 7)
    ))
    assert {tuple(r) for r in roll.totals().collect()} == {("s", "en", "1", 2, 17), ("s", None, "1", 1, 4)}
    assert Counter((r.doc_id, r.n_tokens, r.sign) for r in roll.refused().collect()) == {(3, 5, -1): 1, (3, 6, 1): 1, (9, 1, -1): 1}
    before = {tuple(r) for r in roll.documents().collect()}
    assert roll.compact() and roll.compact()
    assert {tuple(r) for r in roll.documents().collect()} == before == {(1, "s", "en", "1", 12, 1), (2, "s", "en", "1", 5, 1), (3, "s", None, "1", 4, 1)}
    assert not roll.apply("b", frame((-1, 1, "s", "en", "1", 12))) and roll.apply("c", frame((-1, 1, "s", "en", "1", 12)))
    assert roll.apply("d", frame()) and {tuple(r) for r in roll.totals().collect()} == {("s", "en", "1", 1, 5), ("s", None, "1", 1, 4)}


def test_counts_of_an_empty_table_and_a_long_text(spark, tmp_path):
    schema = "doc_id long, text string, source string, lang string, n_tokens int, sign int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_counts.op9_token_counts(spark, f"{tmp_path}/none").collect() == []
    rows = [(1, prose(1, 40_000), "s", "en", 1, 1), (2, None, None, None, 1, 1), (2, "again", None, None, 1, 1)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    n = len(ENCODER.encode_bytes(rows[0][1])) // 4
    got = {(r.source, r.version): (r.n_docs, r.n_tokens) for r in token_counts.op9_token_counts(spark, f"{tmp_path}/some").collect()}
    m = len(ENCODER.encode_bytes("again")) // 4
    assert got == {("s", "1"): (1, n), ("s", "2"): (1, n + math.ceil(n / 1024)), (None, "1"): (1, m), (None, "2"): (2, m + 2)}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=50) | st.text(alphabet="abcdeithns '.\n\t0", max_size=80) | st.text(alphabet="aé日 ́🙂", max_size=40))
def test_both_encoders_agree(text):
    assert ENCODER.encode_bytes(text) == LIBRARY.encode_bytes(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeithnsé", min_size=1, max_size=200), st.integers(1, 40))
def test_long_words_chunk_by_chunk(word, chunk):
    before = bpe.CHUNK
    bpe.CHUNK = chunk
    try:
        assert ENCODER.encode_long_word(word) == LIBRARY.library.encode_ordinary(word)
    finally:
        bpe.CHUNK = before


def test_one_very_long_word():
    r = random.Random(2)
    word = "".join(r.choice("abcdefghij") for _ in range(300_000))
    assert ENCODER.encode_long_word(word)[:50] == LIBRARY.library.encode_ordinary(word[:2000])[:50]
    assert ENCODER.decode(np.array(ENCODER.encode_long_word(word))) == word.encode()


def naive_best_fit(lengths, window):
    rests = sorted(((n % window, d) for d, n in enumerate(lengths) if n % window), key=lambda x: (-x[0], x[1]))
    full, bins = sum(n // window for n in lengths), []
    for n, d in rests:
        fits = [b for b in bins if window - sum(x for x, _ in b) >= n]
        if fits:
            min(fits, key=lambda b: window - sum(x for x, _ in b)).append((n, d))
        else:
            bins.append([(n, d)])
    return full, Counter(sum(x for x, _ in b) for b in bins)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=50), st.integers(1, 33))
def test_best_fit_equals_a_naive_packer(lengths, window):
    windows, left = packing.best_fit(lengths, window)
    full, sizes = naive_best_fit(lengths, window)
    assert len(windows) - len(left) == full
    assert Counter(sum(n for _, _, n in windows[w]) for w in left) == sizes


def plain_statistics(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    capital = lambda c: "A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ"
    share = lambda test: sum(map(test, text)) / max(1, len(text))
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    return {
        "chars": math.log1p(len(text)), "words": math.log1p(len(words)), "lines_per_word": len(lines) / n_words,
        "word_length": sum(c not in " \t\n\x0b\f\r" for c in text) / n_words, "upper": share(capital), "digits": share(lambda c: c in "0123456789"),
        "symbols": share(lambda c: c in "#$%&*+=<>{}[]\\^~_@/"), "bars": share(lambda c: c == "|"), "exclamations": share(lambda c: c == "!"),
        "periods": share(lambda c: c == "."), "commas": share(lambda c: c == ","), "spaces": share(lambda c: c in " \t\n\x0b\f\r"),
        "distinct_words": len(set(words)) / n_words, "distinct_lines": len(set(lines)) / n_lines, "short_words": sum(len(w) <= 3 for w in words) / n_words,
        "long_words": sum(len(w) > 12 for w in words) / n_words, "common_words": sum(w.lower() in quality.COMMON for w in words) / n_words,
        "ended_lines": sum(x.rstrip(" ")[-1:] in ".!?:;" for x in lines) / n_lines, "capital_words": sum(capital(w[0]) for w in words) / n_words,
    }


def test_scores_equal_rules_in_plain_python(spark):
    """Compiled rules, ties between them included, on odd texts."""
    r = random.Random(4)
    pieces = ["The", "and", "Été", "x" * 14, "12", "a|b", "#!", "end.", "é,", "\n", "\t", "  ", "日本", "\x0b", "?"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(80)] + ["", None, "\n\n", "word " * 20_000]
    names = list(plain_statistics(""))
    rules = {((n, bool(i % 2), 0.1 * (i % 7)),): 0.3 * (-1) ** i for i, n in enumerate(names)}
    rules |= {(("digits", True, 0.05), ("upper", False, 0.0)): 0.5, (("digits", True, 0.05), ("upper", False, 0.01)): 0.5}
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumns({"score": F.lit("clash"), "predicted": F.lit(1)})
    got = {x.i: x for x in quality.scored(docs, quality.Rules(-0.2, rules)).collect()}
    for i, t in enumerate(texts):
        s = plain_statistics(t or "")
        total = -0.2 + sum(w for rule, w in rules.items() if all(s[n] <= at if most else s[n] > at for n, most, at in rule))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), t
        assert got[i].predicted == (got[i].score >= quality.CUT)


def test_growing_table(spark):
    grown = common.Growing(spark, "grown", "a long")
    for i in range(3):
        grown.add(spark.createDataFrame([(i,)] * i, "a long"))
    assert sorted(r.a for r in grown.rows().collect()) == [1, 2, 2]
