"""Cards, documents and signals over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions import signals
from noticeworks.operators import cards, linking, offers
from noticeworks.operators.lineage import cut_lineage
from noticeworks.plans.base import query
from noticeworks.plans.notices import page_titles
from noticeworks.sources import pages as page_source


@query("""WITH d AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events), t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN d END AS a, CASE WHEN event_id % 2 = 0 THEN d + 5 END AS b, CASE WHEN event_id % 5 > 0 THEN d - 2 END AS c FROM d)
    SELECT event_id, coalesce(a, b, c) AS first, greatest(a, b, c) AS latest FROM t""")
def deadlines(t) -> DataFrame:
    """The first and the latest of the deadlines that an answer gives under several keys."""
    k, day = F.col("event_id"), F.to_date("ts")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    raw = F.to_json(F.struct(
        F.when(k % 3 == 0, iso(day)).alias("data_chiusura"), F.when(k % 2 == 0, iso(F.date_add(day, 5))).alias("expires"), F.struct(F.when(k % 5 > 0, iso(F.date_sub(day, 2))).alias("data_scadenza")).alias("attributes"),
    ))
    rows = t("events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", signals.first_deadline(F.col("raw")).alias("first"), signals.latest_deadline(F.col("raw")).alias("latest"))


NAMES = [
    ("Bando 2026", "bando"), ("Avviso pubblico - bozza", "bando"), ("Domande frequenti", "faq"), ("Modulo di domanda", "modulistica"), ("Decreto 5-3-2026", "decreto"), ("D.D. n. 12 del 1.2.2025", "decreto"),
    ("Graduatoria finale", "graduatoria"), ("Determina 2024", "decreto"), ("Brochure", "altro"), ("Allegato A", "bando"), ("Allegato B", "modulistica"), ("Delibera 31/12/2026", "decreto"),
]
KIND_SQL = " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(NAMES))
NAME_SQL = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(NAMES))


@query(f"""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST((l_orderkey + 5 * l_linenumber) % {len(NAMES)} AS INTEGER) AS i FROM lineitem),
    n AS (SELECT *, CASE i {NAME_SQL} END AS name, CASE i {KIND_SQL} END AS category FROM d),
    o AS (SELECT *, CASE category WHEN 'bando' THEN 0 WHEN 'faq' THEN 2 WHEN 'decreto' THEN 3 WHEN 'graduatoria' THEN 4 ELSE 5 END AS k, i = 1 AS old, CASE i WHEN 4 THEN 20260305 WHEN 5 THEN 20250201 WHEN 7 THEN 20240000 WHEN 11 THEN 20261231 ELSE 0 END AS dated FROM n WHERE category <> 'modulistica')
    SELECT l_orderkey, l_linenumber, category, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k, old, dated DESC, l_linenumber) AS INTEGER) AS place FROM o""")
def ordered_documents(t) -> DataFrame:
    """Documents of each call by kind, those in force and the newest decree first; forms are left out."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = F.element_at(F.array(*[F.lit(n) for n, _ in NAMES]), ((F.col("l_orderkey") + 5 * F.col("l_linenumber")) % len(NAMES) + 1).cast("int"))
    none = F.lit(None).cast("string")
    rows = rows.withColumn("name", name).withColumn("category", signals.document_category(F.col("name"), F.lit(""), F.lit("pdf"), none)).filter("category != 'modulistica'")
    order = signals.document_order(F.col("category"), F.col("name"), F.lit(""))
    return rows.select("l_orderkey", "l_linenumber", "category", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order, "l_linenumber")).alias("place"))


@query("""WITH c AS (SELECT p_partkey AS k, p_size AS s FROM part)
    SELECT k AS card_id, concat_ws('; ', CASE WHEN s % 3 = 1 THEN 'sizes: not admitted: enorme' END, CASE WHEN s % 5 = 0 THEN 'deadline_at: no hour' END, CASE WHEN s % 4 = 0 THEN 'opens after the deadline' END, CASE WHEN s % 11 = 0 THEN 'deadline too old' END,
        CASE WHEN s % 7 = 0 THEN 'contribution_max: not plausible' END, CASE WHEN s > 40 THEN 'percent: over 100' END, CASE WHEN s % 7 <> 0 AND s % 6 = 5 THEN 'grant above the contribution' END,
        CASE WHEN s % 2 = 1 THEN 'territory: state missing' END, 'subjects: state missing', 'forms: state missing', CASE WHEN s % 3 = 0 THEN 'sizes: stated but not given' END, 'codes: state missing', 'age: state missing', 'requirements: state missing',
        'staff: state missing', 'turnover: state missing', 'spend: state missing', 'regime: state missing') AS problems FROM c""")
def card_checks(t) -> DataFrame:
    """All failed checks of made-up cards."""
    s = F.col("p_size")
    day = F.when(s % 11 == 0, F.lit("2010-05-01")).otherwise(F.lit("2026-05-01")).cast("date")
    none = F.array().cast("array<string>")
    rows = t("part").select(
        F.col("p_partkey").alias("card_id"), F.when(s % 3 == 0, none).when(s % 3 == 1, F.array(F.lit("micro"), F.lit("enorme"))).otherwise(F.array(F.lit("micro"))).alias("sizes"),
        F.when(s % 5 == 0, "25:00").otherwise("12:30").alias("deadline_at"), day.alias("deadline"), F.when(s % 4 == 0, F.date_add(day, 1)).otherwise(F.date_sub(day, 9)).alias("opens"),
        F.when(s % 7 == 0, -1.0).otherwise(1000.0).alias("contribution_max"), (s * 2.5).alias("percent"), F.when((s % 6 == 5) & (s % 7 != 0), 2000.0).alias("grant_max"),
        F.create_map(F.lit("territory"), F.when(s % 2 == 0, "non_noto").otherwise("x"), F.lit("sizes"), F.lit("vincolo")).alias("constraints"),
    )
    return rows.select("card_id", F.array_join(cards.card_problems(rows), "; ").alias("problems"))


@query("""SELECT c_custkey, CASE greatest(CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 END, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END)
    WHEN 0 THEN 'micro' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'large' END AS size FROM customer""")
def size_bands(t) -> DataFrame:
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("c_custkey") % n + 1).cast("int"))
    return t("customer").select("c_custkey", offers.size_from_bands(pick(6, "0", "1-9", "10-49", "50-249", "250+", "?"), pick(5, "fino_2m", "2m-10m", "10m-50m", "oltre_50m", None)).alias("size"))


def today() -> Column:
    return F.lit("2026-09-12").cast("date")


@query()
def page_states(t) -> DataFrame:
    """What the head of each page's text and its struck-through dates say of a call's state."""
    text = page_source.readable_text(t("pages").withColumn("struck", signals.struck_dates(F.col("html"), today())), "struck")
    found = text.withColumn("s", signals.page_signals(F.col("text"), today(), F.lit(None).cast("date")))
    closed = F.concat("s.closed", "struck")
    return found.select("page_id", F.size(closed).alias("closed"), F.size("s.opened").alias("opened"), signals.fused_state(closed, F.col("s.opened")).alias("state"))


@query()
def official_pages(t) -> DataFrame:
    """Whether each page is one of a call."""
    links = page_source.links(t("pages"), least=1).filter(F.col("url").rlike(r"(?i)\.(pdf|docx?|xlsx?|zip)$")).groupBy("page_id").agg(F.count("*").alias("documents"))
    rows = page_source.readable_text(t("pages").withColumn("password", F.col("html").rlike(r"(?i)type=[\"']?password")), "password").join(links, "page_id", "left")
    return rows.select("page_id", signals.official_page(F.col("text"), F.coalesce("documents", F.lit(0)), F.coalesce("password", F.lit(False))).alias("verdict"))


@query()
def link_changes(t) -> DataFrame:
    """What linking the pages changes where every fourth page was linked before."""
    rows = cut_lineage(page_titles(t("pages")))
    announcements = rows.select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("call_id"), (F.col("id") % 8 == 0).alias("by_hand"), "title")
    calls = rows.filter(F.col("id") % 4 == 0).select(F.col("id").alias("call_id"), F.lit(False).alias("kept"))
    parts = cards.persisted(announcements, cut_lineage(linking.link_groups(rows)), calls)  # each of four counts reads what is linked once
    counts = [df.agg(F.lit(n).alias("change"), F.count("*").alias("n")) for n, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query()
def lost_and_found(t) -> DataFrame:
    """Every fifth benchmark text looked up among the others by the likeness of its words."""
    rows = t("benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("title"))
    return cards.found_elsewhere(rows.filter("id % 5 = 0"), rows.filter("id % 5 > 0"), 0.3)
