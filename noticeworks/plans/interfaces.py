"""Answers of interfaces of several families, made of the test tables and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.lineage import cut_lineage
from noticeworks.plans.base import query
from noticeworks.sources import interfaces, readers

FAMILY_OF_PAGE = ["generic", "plone", "ckan", "opencity"]
BASE = "https://h.example/list/"


def answers(documents: DataFrame) -> DataFrame:
    """page and raw: the answer of an interface for 64 numbers of documents each, in the form of one of four families."""
    k, page = F.col("doc_id"), F.floor(F.col("doc_id") / 64)
    title, digest, day = F.concat(F.lit("Document "), k), F.md5("text"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    record = {
        "generic": F.struct(k.alias("codice"), F.struct(F.array(title).alias("titolo"), F.concat(F.lit("/d/"), k).alias("pagina")).alias("attributes"), F.lit("").alias("Title"), digest.alias("riassunto"), day.alias("data_pubblicazione")),
        "plone": F.struct(F.when(k % 5 == 0, "Folder").otherwise("News Item").alias("@type"), F.concat(F.lit("doc/"), k).alias("@id"), F.concat(F.lit("<b>"), title, F.lit("</b>")).alias("title"), F.struct(F.struct(digest.alias("x")).alias("y")).alias("description"), day.alias("effective"), k.alias("UID")),
        "ckan": F.struct(k.alias("id"), title.alias("name"), F.when(k % 3 > 0, F.concat(title, F.lit(" &amp; more"))).alias("title"), digest.alias("notes"), day.alias("metadata_modified")),
        "opencity": F.struct(
            F.struct(k.alias("id"), F.struct(F.lit("-").alias("de"), title.alias("ita-IT")).alias("name"), F.when(k % 2 == 0, day).alias("published"), F.lit("2025-12-31").alias("modified")).alias("metadata"),
            F.struct(F.struct(digest.alias("abstract")).alias("ita-IT")).alias("data"),
        ),
    }
    wrap = {
        "generic": lambda items: F.concat(F.lit('{"empty": [], "data": {"found": [['), items, F.lit(']]}, "last": [{"title": "no record"}]}')),
        "plone": lambda items: F.concat(F.lit('{"items": ['), items, F.lit("]}")),
        "ckan": lambda items: F.concat(F.lit('{"result": {"results": ['), items, F.lit("]}}")),
        "opencity": lambda items: F.concat(F.lit('{"searchHits": ['), items, F.lit("]}")),
    }
    at = (page % len(FAMILY_OF_PAGE)).cast("int")

    def by_page(values: dict[str, Column]) -> Column:
        return reduce(lambda c, i: c.when(F.col("family") == i, values[FAMILY_OF_PAGE[i]]), range(1, 4), F.when(F.col("family") == 0, values["generic"]))

    rows = documents.filter("doc_id IS NOT NULL").withColumn("family", at).select(page.alias("page"), "family", by_page({f: F.to_json(r) for f, r in record.items()}).alias("record"))
    pages = rows.groupBy("page", "family").agg(F.array_join(F.collect_list("record"), ", ").alias("items"))
    return pages.select("page", "family", by_page({f: w(F.col("items")) for f, w in wrap.items()}).alias("raw"))


@query("""WITH d AS (SELECT doc_id AS k, (doc_id // 64) % 4 AS f, md5(text) AS h, CAST(DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS day FROM documents WHERE doc_id IS NOT NULL)
    SELECT k // 64 AS page, CAST(k AS VARCHAR) AS external_id, 'Document ' || k || CASE WHEN f = 2 AND k % 3 > 0 THEN ' & more' ELSE '' END AS title,
        CASE f WHEN 0 THEN 'https://h.example/d/' || k WHEN 1 THEN 'https://h.example/list/doc/' || k WHEN 2 THEN 'https://www.dati.gov.it/view-dataset/dataset?id=' || k ELSE 'https://h.example/list/#' || k END AS url,
        h AS summary, CASE WHEN f = 3 AND k % 2 > 0 THEN DATE '2025-12-31' ELSE day END AS published
    FROM d WHERE NOT (f = 1 AND k % 5 = 0)""")
def interface_records(t) -> DataFrame:
    """The documents as announcements of interfaces' answers: four families, nested lists, wrapped values, templates, folders left out."""
    pages = cut_lineage(answers(t("documents")))  # four readers follow: the texts are read once
    parts = []
    for i, family in enumerate(FAMILY_OF_PAGE):
        items = interfaces.records(pages.filter(F.col("family") == i), interfaces.FAMILIES[family]).select("page", F.col("item").alias("raw"))
        parts.append(readers.from_json(items, base=BASE, family=family))
    return reduce(DataFrame.unionByName, parts).select("page", *readers.ANNOUNCEMENT)
