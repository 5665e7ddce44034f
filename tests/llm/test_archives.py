"""Archives: record ids, payloads by broadcast or by page, parts of runs, stores."""

import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import warc
from noticeworks.llm.common import fresh_path

SHARED = "<html>" + "same " * 40


@pytest.mark.parametrize("most", [0, 200_000])
def test_revisits_by_page_or_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", most)
    rows = [(i, f"http://a.example/{i % 7}", SHARED if i % 3 else f"<p>{i}</p>" * 30) for i in range(60)]
    rows += [(None, f"http://n.example/{i}", SHARED) for i in range(40)] + [(None, "x", "<i>" * 90)] * 2 + [(2, "again", "<b>" * 90), (70, "y", "<b>" * 90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns({"captured_at": F.lit("2024-01-01T00:00:00Z"), "first": F.lit("clash"), "salt": F.lit(1)})
    folder = fresh_path(spark, "warc-ids")
    out = warc.capture_history(pages, folder).collect()
    want = Counter()
    for page, _, html in rows:
        first = {SHARED: 1, "<b>" * 90: 2}.get(html)
        again = first is not None and page != first
        want[page, "revisit" if again else "response", first if again else None] += 1
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == want
    disk, base = warc.store(folder)
    raws = []
    for name in {r.archive for r in out}:
        with disk.open_input_stream(f"{base}/{name}", compression=None) as stream:
            raws += [raw.decode() for _, raw in warc.members(stream)]
    ids = [re.search(r"WARC-Record-ID: <(.*?)>", raw)[1] for raw in raws]
    assert len(set(ids)) == len(ids) == len(rows)
    named = {i: raw for i, raw in zip(ids, raws)}
    for raw in raws:
        if "WARC-Type: revisit" in raw:
            target = named[re.search(r"WARC-Refers-To: <(.*?)>", raw)[1]]
            assert "WARC-Type: response" in target
            assert re.search(r"\nPage-ID: (\d+)", target)[1] == re.search(r"Refers-To-Page-ID: (\d+)", raw)[1]


def test_parts_of_runs():
    row = lambda archive, rank: ("k", "t", rank, "response", 1, "d", None, archive, rank, rank)
    rows = [row("a", 0), row("a", 3), row("b", 1), row("b", 2), row("b", 0), row("a", 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*warc.CAPTURE_FIELDS, "rank"])
    parts = [[r[7:] for r in warc.unfolded(p)] for p in warc.parts_of_runs(batch)]
    assert parts == [[("a", 0), ("a", 3)], [("b", 1), ("b", 2)], [("b", 0)], [("a", 5)]]
    assert list(warc.parts_of_runs(batch.slice(0, 0))) == []


def test_members_end_within_a_record():
    import io

    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = z.compress(b"x" * 5000) + z.flush()
    assert [r for _, r in warc.members(io.BytesIO(raw + raw))] == [b"x" * 5000] * 2
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(raw + raw[:20])))
