
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from noticeworks.llm import passages, pii

from .conftest import corpus, prose
from .test_duplicates import brute_removed


@pytest.mark.parametrize("hot, block_bytes", [(0, 1), (3, 3000), (3, 1 << 21)])
def test_passages_of_hot_grams(spark, hot, block_bytes):
    passage = prose(98, 30)
    rows = [*corpus(), *((200 + i, f"{prose(200 + i, 9)} {passage} {prose(300 + i, 9)}") for i in range(40)), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    out = passages.remove_repeats(docs, block_bytes=block_bytes, hot=hot)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == brute_removed(rows)


def test_windows_of_a_common_passage_do_not_meet():
    """The contexts around a passage all stand under two grams; its windows are dealt evenly, each once a block."""
    passage, n = prose(98, 30), 400
    text = [f"{prose(200 + i, 9)} {passage} {prose(900 + i, 9)}" for i in range(n)]
    (raw,) = passages.to_blocks(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": text})]))
    block = passages.Block(raw.column(2)[0].as_py())
    sample = passages.Sample(block, 50)
    gram, places = np.unique(sample.hash, return_counts=True)
    pick = np.flatnonzero(np.isin(sample.hash, gram[places >= n]))
    assert max(Counter(sample.hash[pick[passages.Classes(block, sample, pick, 50).head]].tolist()).values()) > 0.8 * n
    windows = passages.Windows(block, sample, pick, 50)
    assert len({r.tobytes() for r in windows.rows}) == len(windows.rows)
    dealt = np.bincount((passages.text_hashes(windows.rows) % np.uint64(20)).astype(int), minlength=20)
    assert dealt.max() < 1.3 * dealt.mean()


def test_pii_secrets_of_other_shapes_and_ibans_before_words(spark):
    texts = [
        "password=12345678901234 token: GB12ABCD1234EFGH5678 card 12345678901234",
        "ES91 2100 0418 4502 0005 1332 EUR 500", "SE45 5000 0000 0583 9825 7466 4111 1111 1111 1111", "password=abcdefghijkltoken=12345678901234",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n) for r in pii.pseudonymised(docs, "k", count_col="n").collect()}
    assert re.fullmatch(r"password=[0-9a-f]{14} token: [0-9a-f]{20} card 12345678901234", out[0][0]) and "password=12345678901234" not in out[0][0] and out[0][1] == 2
    number = re.fullmatch(r"(ES\d\d(?: \d{4}){5}) EUR 500", out[1][0])[1].replace(" ", "")
    assert number != "ES9121000418450200051332" and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1
    assert out[2][1] == 2 and "5000 0000" not in out[2][0] and "4111 1111 1111 1111" not in out[2][0]
    assert "12345678901234" not in out[3][0] and "abcdefghijkl" not in out[3][0]


def test_passage_stage_keeps_replacement_characters_of_the_source(spark):
    same = prose(97, 12)
    texts = ["日" + same + "本", "a\ufffdb 日" + same + "本 c\ufffd", "é\ufffd" + same + "\ufffe ü", "x\u6588" + same + "\u65e5y"]
    first, out = {}, {}
    for i, raw in enumerate(t.encode() for t in texts):
        gone = set()
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                gone |= set(range(k, k + 50))
        at, kept = 0, ""
        for c in texts[i]:
            n = len(c.encode())
            kept += "" if gone & set(range(at, at + n)) else c
            at += n
        out[i] = kept
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.passage_stage(spark, docs, "").collect()}
    assert got == out and got[1] == "a\ufffdb  c\ufffd"
