"""Interface answers taken apart by expressions, against the same rules over parsed JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from noticeworks.sources import interfaces, readers

NAMES = ["a", "title", "Title", "titolo", "url", "link", "it", "rendered", "attributes", "metadata", "value", "id", "summary", "date", "z", "x.y", "UID"]
SCALARS = ["", " ", "Bando", "{x}", "[1]", "{\"a\": 1}", "à \"q\" \\ \n", 0, 7, -2.5, None, "http://a/b"]


def made(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.35:
        return rng.choice(SCALARS)
    if pick < 0.55:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    if pick < 0.7:
        return [made_object(rng, depth - 1) for _ in range(rng.randrange(4))]
    return made_object(rng, depth - 1)


def made_object(rng, depth):
    return {k: made(rng, depth) for k in rng.sample(NAMES, rng.randrange(5))}


def lists(value):
    """All lists of objects in the order of the document."""
    if isinstance(value, list):
        if value and all(isinstance(x, dict) for x in value):
            yield value
        inside = value
    else:
        inside = value.values() if isinstance(value, dict) else ()
    for x in inside:
        yield from lists(x)


def words(value):
    if isinstance(value, list):
        return words(value[0]) if value else None
    if isinstance(value, dict):
        wrapper = [k for k in interfaces.WRAPPERS if k in value][:1]
        return words(value[wrapper[0]]) if wrapper else next((t for t in map(words, value.values()) if t), None)
    return None if value is None else str(value).strip() or None


def fields_of(record):
    seen = {}
    for block in [record, *(record.get(k) for k in interfaces.NESTED)]:
        if isinstance(block, dict):
            low = {k.lower(): v for k, v in block.items()}
            seen = low | seen
    return {f: words(next((seen[k.lower()] for k in keys if k.lower() in seen and seen[k.lower()] not in (None, "", [], {})), None)) for f, keys in interfaces.JSON_KEYS.items()}


def test_random_answers(spark):
    rng = random.Random(5)
    values = [made(rng, 6) for _ in range(400)]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "i int, raw string").repartition(4)
    found = {}
    for r in interfaces.records(rows, interfaces.FAMILIES["generic"]).collect():
        found.setdefault(r.i, []).append(json.loads(r.item))
    want = {i: max(lists(v), key=len) for i, v in enumerate(values) if any(True for _ in lists(v))}
    assert len(want) > 100 and found == want
    records = [made_object(rng, 4) for _ in range(400)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(records)], "i int, raw string").repartition(4)
    got = {r.i: r.f.asDict() for r in interfaces.known_fields(rows, "raw", "f").collect()}
    want = {i: fields_of(v) for i, v in enumerate(records)}
    assert sum(x["title"] is not None for x in want.values()) > 50
    assert got == want


def test_odd_answers(spark):
    deep = 60 * '{"k":' + '[{"title": "x"}]' + 60 * "}"
    raws = [None, "", " ", "{", "7", '"{\\"a\\": 1}"', "[]", "{}", '[[{"a": 1}], [{"b": 2}]]', '  [{"a": 1, "a": 2}]', deep, '{"p": [{"x": "[{}, {}]"}]}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").withColumn("nodes", F.lit(1)).withColumn("item_first", F.lit(2))
    found = interfaces.records(rows, interfaces.FAMILIES["generic"])
    assert sorted((r.i, json.loads(r.item)) for r in found.collect()) == [(8, {"a": 1}), (9, {"a": 2}), (10, {"title": "x"}), (11, {"x": "[{}, {}]"})]
    assert interfaces.records(rows.limit(0), interfaces.FAMILIES["generic"]).count() == 0
    assert {r.f.title for r in interfaces.known_fields(rows, "raw", "f").collect()} == {None}
    assert set(interfaces.known_fields(found, "item", "item_").columns) == {"i", "raw", "nodes", "item_first", "item", "item_"}


FIXTURES = {
    "generic": ({"n": 1, "voci": [{"Titolo": "<b>Uno</b> &amp; due", "pagina": "/b/1"}, {"oggetto": "Due", "url": "?p=2"}, {"oggetto": "Tre", "codice": 9}]},
                [("Uno & due", "https://h.it/b/1"), ("Due", "https://h.it/d/l?p=2"), ("Tre", "https://h.it/d/l#9")]),
    "wordpress": ([{"link": "https://w/1", "title": {"rendered": "Uno"}, "date": "2026-09-12T10:00:00", "excerpt": {"rendered": "<p>E</p>"}}], [("Uno", "https://w/1")]),
    "plone": ({"items": [{"@type": "Folder", "@id": "https://p/f", "title": "F"}, {"@id": "https://p/1", "@type": "News", "title": "Uno"}], "facets": [{"title": "q"}] * 3}, [("Uno", "https://p/1")]),
    "opencity": ({"searchHits": [{"metadata": {"id": 3, "name": {"de": "Eins", "ita-IT": "Uno"}, "published": "2026-09-12"}, "data": {"ita-IT": {"abstract": "A"}}}]}, [("Uno", "https://h.it/d/l#3")]),
    "ckan": ({"result": {"results": [{"id": "k-1", "name": "uno", "title": "Uno", "notes": "N", "metadata_modified": "2026-09-12"}]}}, [("Uno", "https://www.dati.gov.it/view-dataset/dataset?id=k-1")]),
}


@pytest.mark.parametrize("family", FIXTURES)
def test_families(spark, tmp_path, family):
    answer, want = FIXTURES[family]
    (tmp_path / "answer.json").write_text(json.dumps(answer, indent=1))
    out = readers.interface(spark, str(tmp_path), "https://h.it/d/l", family)
    assert sorted((r.title, r.url) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_templates(spark):
    rows = spark.createDataFrame([('{"slug": "s-1", "attributes": {"urls": [{"u": " x "}], "n": 5}}',), ('{"slug": null}',), ("{",), (None,)], "raw string")
    got = rows.select(interfaces.from_template(F.try_parse_json("raw"), "https://x/{slug}/{attributes.urls[0].u}?n={attributes.n}").alias("u")).collect()
    assert [r.u for r in got] == ["https://x/s-1/x?n=5", None, None, None]
    out = readers.from_json(spark.createDataFrame([('{"title": "T", "url": "/own", "id": 4}',), ('{"title": "T", "url": "/own"}',)], "raw string"), base="https://h.it/a/", address="https://x/{id}")
    assert [r.url for r in out.collect()] == ["https://x/4", "https://h.it/own"]
