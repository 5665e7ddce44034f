
from noticeworks import catalogue
from noticeworks.plans import notices

from .test_linking import in_order


def test_fold_texts_whole_and_in_every_language(spark, tmp_path):
    long = "x" * 300 + " Così l’Été"
    rows = [(1, long, "de"), (2, long, None), (3, "È", "fr"), (4, None, "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.folded for r in catalogue.QUERIES["fold_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: "x" * 300 + " cosi l'ete", 2: "x" * 300 + " cosi l'ete", 3: "e", 4: None}


def test_link_pages_by_all_three_rules(spark, tmp_path):
    page = lambda title, body="": f'<html lang="it"><head><title>{title}</title></head><body>{"x " * 300}{body}</body></html>'
    long = " ".join(f"parola{i}" for i in range(20))
    pages = [
        (1, "http://a.it/1", page("Voucher digitali imprese", "RLA12026001234")), (2, "http://b.it/2", page("Altro testo nuovo", "codice RLA12026001234.")),
        (3, "http://a.it/3", page("Contributi energia pulita 2026")), (4, "http://a.it/4?x=1", page("Contributi energia pulita 2026")),
        (5, "http://www.c.it/5", page("Fiere estere")), (6, "http://c.it/5/?utm_source=q", page("Fiere estere bando")),
        (7, "http://d.it/7", page(f"{long} agricoltura pesca caccia bosco mare monte lago fiume")), (8, "http://d.it/8", page(f"{long} turismo scuola ponte strada casa nave treno volo")), (9, "http://e.it", None),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = notices.page_titles(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()
    got = {r.id: (r.call, r.how, r.doubt) for r in catalogue.QUERIES["link_pages"](spark, str(tmp_path)).collect()}
    assert got == in_order([(r.id, r.source, r.issuer, r.territory, [u for u in r.urls if u], r.code, r.title, r.seen) for r in rows])
    assert got[2][:2] == (1, "code") and got[4][:2] == (3, "title") and got[6][:2] == (5, "url")
    assert got[8] == (8, "new", None)  # two pages of one source whose titles share less than 0.8
