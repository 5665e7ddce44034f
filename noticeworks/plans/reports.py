"""Supervision reports and cost figures over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions import notices
from noticeworks.functions import text as tx
from noticeworks.plans.base import query
from noticeworks.streaming import visits


@query("""WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 1 END AS merged_into, c_mktsegment AS state FROM customer)
    SELECT s.id, coalesce(u.id, s.id) AS target, coalesce(u.state, s.state) AS state FROM s LEFT JOIN s u ON u.id = s.merged_into""")
def merged_view(t) -> DataFrame:
    """Rows that were merged show the state of the row they went into (one step)."""
    s = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 3, F.col("c_custkey") + 1).alias("merged_into"), F.col("c_mktsegment").alias("state"))
    u = s.select(F.col("id").alias("u_id"), F.col("state").alias("u_state"))
    return s.join(u, F.col("merged_into") == F.col("u_id"), "left").select("id", F.coalesce("u_id", "id").alias("target"), F.coalesce("u_state", "state").alias("state"))


@query("""SELECT a.p_partkey, CAST(count(b.p_partkey) AS BIGINT) AS others FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY 1""")
def same_page_others(t) -> DataFrame:
    """How many other rows share a row's key: a count over the key, not a self-join."""
    w = Window.partitionBy("p_brand", "p_size")
    return t("part").select("p_partkey", (F.count("*").over(w) - 1).alias("others")).filter("others > 0")


@query("""SELECT date_trunc('month', ts) AS month, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN event_type = 'purchase' THEN (value * 3 + 500 * 15) / 1e6 / 2 ELSE (value * 3 + 500 * 15) / 1e6 END), 6) AS cost
    FROM events WHERE ts >= date_trunc('month', TIMESTAMP '2024-01-31') AND ts < TIMESTAMP '2024-01-31' GROUP BY 1""")
def month_to_date_cost(t) -> DataFrame:
    cost = notices.call_cost(F.col("value"), F.lit(500), 3.0, 15.0, F.col("event_type") == "purchase")
    rows = t("events").filter("ts >= date_trunc('month', TIMESTAMP '2024-01-31') AND ts < TIMESTAMP '2024-01-31'")
    return rows.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) * CASE event_type WHEN 'click' THEN 0.017 WHEN 'view' THEN 0.0046 WHEN 'error' THEN 0.0097 ELSE 0.1 END, 6) AS estimate FROM events GROUP BY 1""")
def in_flight_cost(t) -> DataFrame:
    n = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("estimate", notices.in_flight(F.col("n"), F.col("event_type"), {"click": "0.017", "view": "0.0046", "error": "0.0097"}))


@query("""SELECT n_name, CAST(count(c_custkey) AS BIGINT) AS customers, CAST(count(c_custkey) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS negative, round(100.0 * count(c_custkey) FILTER (WHERE c_acctbal < 0) / greatest(count(c_custkey), 1), 1) AS share
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def silent_sources(t) -> DataFrame:
    """Every source, also those without any row."""
    rows = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    bad = F.count_if(F.col("c_acctbal") < 0)
    return rows.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), bad.alias("negative"), tx.percent(bad, F.count("c_custkey")).alias("share"))


@query(r"""WITH v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Mozilla/5.0 (compatible; GPTBot/1.1)' WHEN 1 THEN 'Googlebot/2.1' WHEN 2 THEN 'curl/8.5' WHEN 3 THEN '' ELSE 'Mozilla/5.0 Firefox/130' END AS agent, url FROM pages),
    k AS (SELECT CASE WHEN trim(agent) = '' THEN 'other' WHEN contains(lower(agent), 'gptbot') THEN 'ai' WHEN contains(lower(agent), 'googlebot') THEN 'search' WHEN contains(lower(agent), 'curl/') THEN 'other' ELSE 'person' END AS kind,
        regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z-]+://([^/?#:]*)', 1)), '^www\.', ''), '^m\.', '') AS domain FROM v)
    SELECT kind, domain, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2""")
def visit_kinds(t) -> DataFrame:
    """Visits by kind of visitor and referring domain."""
    agents = ["Mozilla/5.0 (compatible; GPTBot/1.1)", "Googlebot/2.1", "curl/8.5", ""]
    agent = F.coalesce(F.get(F.array(*map(F.lit, agents)), (F.col("page_id") % 6).cast("int")), F.lit("Mozilla/5.0 Firefox/130"))
    kind, domain = visits.visitor_kind(agent), visits.referrer_domain(F.col("url"), ["nobody.example"])
    return t("pages").groupBy(kind.alias("kind"), domain.alias("domain")).agg(F.count("*").alias("n"))


@query("""SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE '/doc/' || d.doc_id = '/doc/' || (p.page_id * 7))""")
def never_read(t) -> DataFrame:
    """Left-anti join on a key that is put together."""
    docs = t("documents").select(F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("path"))
    pages = t("pages").select("page_id", F.concat(F.lit("/doc/"), (F.col("page_id") * 7).cast("string")).alias("path"))
    return pages.join(docs, "path", "left_anti").select("page_id")


@query("""SELECT c_custkey, p.campaign, p.since FROM customer JOIN (SELECT unnest([1, 2, 3]) AS campaign, unnest([DATE '2001-01-01', DATE '2001-02-01', DATE '2001-03-01']) AS since, unnest(['BUILDING', 'MACHINERY', 'FURNITURE']) AS seg) p ON c_mktsegment = p.seg""")
def parameter_table(t) -> DataFrame:
    """Rows joined with parameters that come as parallel arrays (three rows)."""
    customer = t("customer")
    one = customer.sparkSession.range(1).select(F.expr("inline(arrays_zip(array(1, 2, 3), array(DATE'2001-01-01', DATE'2001-02-01', DATE'2001-03-01'), array('BUILDING', 'MACHINERY', 'FURNITURE')))"))
    one = one.toDF("campaign", "since", "seg")
    return customer.join(F.broadcast(one), F.col("c_mktsegment") == F.col("seg")).select("c_custkey", "campaign", "since")


@query("""SELECT event_type AS name, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2)""")
def event_matrix(t) -> DataFrame:
    n = t("events").groupBy(F.col("event_type").alias("name"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.partitionBy("name").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
