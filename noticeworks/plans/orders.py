"""Catalogues, funnels, merges and campaigns, over the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.text import contains_all_words, percent
from noticeworks.operators import documents, health, history, lifecycle
from noticeworks.plans.base import query


def conjunction(df: DataFrame, predicates: list) -> DataFrame:
    """Filters by those predicates that are set; None stands for a parameter that was not given."""
    return reduce(lambda d, p: d.filter(p), (p for p in predicates if p is not None), df)


def catalogue(orders: DataFrame, customer: DataFrame, nation: DataFrame, *, text: str | None = None, states: list[str | None] | None = None,
              since: str | None = None, until: str | None = None, nations: list[str] | None = None, number: int | None = None) -> DataFrame:
    """Orders with customer and nation under optional filters.  A number finds its row whatever the other filters say."""
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    if number is not None:
        return rows.filter(F.col("o_orderkey") == number)
    state = None
    if states is not None:
        state = F.col("o_orderstatus").isin([s for s in states if s]) | (F.col("o_orderstatus").isNull() if None in states else F.lit(False))
    return conjunction(rows, [
        F.concat_ws(" ", "c_name", "o_orderpriority", "n_name").ilike(f"%{text}%") if text else None,
        state,
        F.col("o_orderdate") >= F.lit(since).cast("date") if since else None,
        F.col("o_orderdate") < F.date_add(F.lit(until).cast("date"), 1) if until else None,
        F.col("n_name").isin(nations) if nations else None,
    ])


@query("""SELECT o_orderkey, c_name, n_name, o_totalprice, CAST(count(*) OVER () AS BIGINT) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE concat_ws(' ', c_name, o_orderpriority, n_name) ILIKE '%urgent%' AND o_orderstatus IN ('O', 'P')
      AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25""")
def announcement_catalogue(t) -> DataFrame:
    """One page of a filtered list, with the number of all hits."""
    rows = catalogue(t("orders"), t("customer"), t("nation"), text="urgent", states=["O", "P"], since="1996-01-01", until="1997-12-31")
    page = rows.select("o_orderkey", "c_name", "n_name", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(25).limit(50)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE lower(concat_ws(' ', c_name, o_orderpriority, c_mktsegment)) LIKE '%customer%' AND lower(concat_ws(' ', c_name, o_orderpriority, c_mktsegment)) LIKE '%high%'
      AND lower(concat_ws(' ', c_name, o_orderpriority, c_mktsegment)) LIKE '%build%'""")
def word_search(t) -> DataFrame:
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.filter(contains_all_words(F.concat_ws(" ", "c_name", "o_orderpriority", "c_mktsegment"), "Customer high BUILD")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 32")
def number_lookup(t) -> DataFrame:
    return catalogue(t("orders"), t("customer"), t("nation"), text="nothing has this", number=32).select("o_orderkey", "n_name")


PHASES = ["to_sort", "to_review", "urgent", "linked", "late", "rest"]
PHASE_SQL = """CASE WHEN o_orderstatus IS NULL THEN 'to_sort' WHEN o_orderstatus = 'P' THEN 'to_review' WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 'urgent'
    WHEN o_orderstatus = 'F' THEN 'linked' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'late' ELSE 'rest' END"""


def phase():
    status = F.col("o_orderstatus")
    return lifecycle.first_of([
        (status.isNull(), "to_sort"), (status == "P", "to_review"), (F.col("o_orderpriority").startswith("1") & (status == "O"), "urgent"),
        (status == "F", "linked"), (F.col("o_orderdate") < "1996-01-01", "late"),
    ], "rest")


@query(f"""SELECT p.phase, CAST(count(o.o_orderkey) AS BIGINT) AS n FROM (VALUES ('to_sort'), ('to_review'), ('urgent'), ('linked'), ('late'), ('rest')) p(phase)
    LEFT JOIN (SELECT *, {PHASE_SQL} AS phase FROM orders) o ON o.phase = p.phase GROUP BY 1""")
def funnel_phases(t) -> DataFrame:
    return health.zero_filled(t("orders").groupBy(phase().alias("phase")).agg(F.count("*").alias("n")), "phase", PHASES)


@query("""WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
    j AS (SELECT o.*, l.* FROM orders o LEFT JOIN l ON o_orderkey = l_orderkey)
    SELECT o_orderkey, CASE WHEN lines IS NULL THEN 'no_document' WHEN returned > 2 THEN 'stopped' WHEN o_orderstatus IS DISTINCT FROM 'O' AND returned > 0 THEN 'review'
        WHEN shipped > o_orderdate + INTERVAL 100 DAY THEN 'update_due' WHEN o_orderstatus = 'O' THEN 'proposable' ELSE 'aside' END AS situation,
        CASE WHEN lines IS NULL THEN 'machine' WHEN returned > 0 THEN 'person' ELSE 'machine' END AS decider FROM j""")
def situations(t) -> DataFrame:
    """Ordered rules over a row and its aggregated details."""
    flag = F.col("l_returnflag") == "R"
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(flag).alias("returned"), F.max("l_shipdate").alias("shipped"))
    rows = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.col("lines").isNull()
    situation = lifecycle.first_of([
        (none, "no_document"), (F.col("returned") > 2, "stopped"), (~F.col("o_orderstatus").eqNullSafe("O") & (F.col("returned") > 0), "review"),
        (F.col("shipped") > F.col("o_orderdate") + F.expr("INTERVAL 100 DAY"), "update_due"), (F.col("o_orderstatus") == "O", "proposable"),
    ], "aside")
    decider = lifecycle.first_of([(none, "machine"), (F.col("returned") > 0, "person")], "machine")
    return rows.select("o_orderkey", situation.alias("situation"), decider.alias("decider"))


@query("SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-01' WHERE o_orderkey IS NULL")
def untriaged(t) -> DataFrame:
    recent = t("orders").filter("o_orderdate >= '2001-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(recent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'open' ELSE 'clear' END AS mark FROM customer""")
def with_exists(t) -> DataFrame:
    open_orders = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    rows = t("customer").join(open_orders, "c_custkey", "left")
    return rows.select("c_custkey", F.when((F.col("c_acctbal") < 0) | F.col("hit"), "open").otherwise("clear").alias("mark"))


@query("""SELECT c_custkey, x.o_orderkey, x.o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true""")
def latest_per_source_lateral(t) -> DataFrame:
    last = history.newest(t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return t("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, coalesce(n, 0) AS n, coalesce(spent, 0) AS spent FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def correlated_counts(t) -> DataFrame:
    sums = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    rows = t("customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


def snapshots(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An older table and newer readings of it: later orders are new, every seventh has changed."""
    rows = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("seen"))
    old = rows.filter("seen < '2000-01-01'")
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    new = rows.filter("seen >= '1999-01-01'").withColumn("title", changed).withColumn("status", F.when(F.col("o_orderkey") % 5 != 0, F.col("status")))
    return old, new


SNAPSHOT_SQL = """old AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS title, o_orderdate AS seen FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
    new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS title,
        o_orderdate AS seen FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')"""


@query(f"""WITH {SNAPSHOT_SQL} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
    CASE WHEN o.o_orderkey IS NULL OR (n.o_orderkey IS NOT NULL AND o.title <> n.title) THEN coalesce(n.status, o.status) ELSE o.status END AS status,
    CASE WHEN o.o_orderkey IS NULL OR (n.o_orderkey IS NOT NULL AND o.title <> n.title) THEN n.title ELSE o.title END AS title,
    CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NOT NULL AND o.title <> n.title THEN 'update' ELSE 'unchanged' END AS action
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def upsert_merge(t) -> DataFrame:
    old, new = snapshots(t("orders"))
    return history.upsert(old.drop("seen"), new.drop("seen"), ["o_orderkey"], "title", ("status",))


@query(f"""WITH {SNAPSHOT_SQL} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
    CASE WHEN o.o_orderkey IS NOT NULL AND (n.o_orderkey IS NULL OR o.status <> 'O') THEN o.status ELSE n.status END AS status,
    CASE WHEN o.o_orderkey IS NOT NULL AND (n.o_orderkey IS NULL OR o.status <> 'O') THEN o.title ELSE n.title END AS title
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def guarded_merge(t) -> DataFrame:
    old, new = snapshots(t("orders"))
    return history.guarded_merge(old.drop("seen"), new.drop("seen"), "o_orderkey", "status", "O")


@query(f"WITH {SNAPSHOT_SQL} SELECT o.o_orderkey, o.status, o.title FROM old o JOIN new n USING (o_orderkey) WHERE o.title IS DISTINCT FROM n.title OR o.status IS DISTINCT FROM n.status")
def change_history(t) -> DataFrame:
    old, new = snapshots(t("orders"))
    return history.archived_versions(old, new, "o_orderkey", ["title", "status"]).select("o_orderkey", "status", "title")


@query(f"WITH {SNAPSHOT_SQL} SELECT n.o_orderkey, n.title FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.o_orderkey = n.o_orderkey)")
def idempotent_append(t) -> DataFrame:
    old, new = snapshots(t("orders"))
    return history.only_new(new, old, ["o_orderkey"]).select("o_orderkey", "title")


@query("""SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1
    UNION ALL SELECT o_orderpriority, 1 FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1""")
def counter_increment(t) -> DataFrame:
    rows = t("orders").select("o_orderpriority", "o_orderdate")
    counters = rows.filter("o_orderdate < '2000-01-01'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    changes = rows.filter("o_orderdate >= '2000-01-01'").select("o_orderpriority", F.lit(1).cast("long").alias("n"))
    return history.incremented(counters, changes, ["o_orderpriority"], "n")


@query("""WITH d AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS opens, CAST(max(l_shipdate) AS DATE) AS deadline,
        CAST(min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS DATE) AS closed_on FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN closed_on <= DATE '1998-06-01' THEN 'closed' WHEN deadline < DATE '1998-06-01' THEN 'closed' WHEN opens > DATE '1998-06-01' THEN 'coming'
        WHEN opens IS NOT NULL OR deadline IS NOT NULL THEN 'open' END AS state FROM d""")
def state_from_dates(t) -> DataFrame:
    days = t("lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").cast("date").alias("opens"), F.max("l_shipdate").cast("date").alias("deadline"),
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).cast("date").alias("closed_on"),
    )
    state = lifecycle.state_from_dates(F.col("opens"), F.col("deadline"), F.col("closed_on"), F.lit("1998-06-01").cast("date"))
    return days.select("l_orderkey", state.alias("state"))


def notices(lineitem: DataFrame) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "R", "closure").when(F.col("l_linestatus") == "F", "extension").otherwise("faq")
    return lineitem.select(
        F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("notice_id"), F.col("l_shipdate").cast("date").alias("day"), role.alias("role"), F.col("l_shipdate").alias("linked_at")
    )


@query("""SELECT o_orderkey AS call_id, CAST(min(l_shipdate) AS DATE) AS closed_on, CAST(arg_min(l_linenumber, (CAST(l_shipdate AS DATE), l_linenumber)) AS INTEGER) AS notice_id
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1997-10-04' AND DATE '1998-02-01' AND CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) GROUP BY 1""")
def auto_close(t) -> DataFrame:
    calls = t("orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").cast("date").alias("opens"), F.lit(None).cast("date").alias("closed_on"))
    done = lifecycle.auto_close(calls, notices(t("lineitem")), F.lit("1998-02-01").cast("date"))
    return done.filter("closed_on IS NOT NULL").select("call_id", "closed_on", "notice_id")


@query("""WITH n AS (SELECT l_orderkey, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'closure' WHEN l_linestatus = 'F' THEN 'extension' ELSE 'faq' END AS role FROM lineitem)
    SELECT o_orderkey AS call_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS stale FROM orders JOIN n ON l_orderkey = o_orderkey
    WHERE role IN ('extension', 'faq') AND l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY 1""")
def mark_stale(t) -> DataFrame:
    calls = t("orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("card_at"))
    return lifecycle.mark_stale(calls, notices(t("lineitem"))).filter("stale IS NOT NULL").select("call_id", "stale")


@query("""WITH s AS (SELECT c_custkey, c_mktsegment, c_nationkey % 5 AS region, CAST(round(sum(o_totalprice)) AS BIGINT) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_mktsegment, region, CAST(count(*) AS BIGINT) AS n, round(avg(spent), 1) AS mean, list_sort(list(spent))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM s GROUP BY 1, 2""")
def segment_rollup(t) -> DataFrame:
    rows = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    spent = rows.groupBy("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 5).alias("region")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("spent"))
    return spent.groupBy("c_mktsegment", "region").agg(F.count("*").alias("n"), F.round(F.avg("spent"), 1).alias("mean"), documents.upper_median("spent").cast("long").alias("median"))


@query("""SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 15""")
def explode_counts(t) -> DataFrame:
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(15)


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, string_agg(o_orderpriority, ';' ORDER BY o_orderdate, o_orderkey) AS path FROM orders GROUP BY 1
    HAVING max(o_orderdate) - min(o_orderdate) > INTERVAL 300 DAY AND count(DISTINCT o_orderstatus) = 3""")
def spread_having(t) -> DataFrame:
    g = t("orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("p"),
        F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first"), F.count_distinct("o_orderstatus").alias("states"),
    )
    g = g.filter("last - first > INTERVAL '300' DAY AND states = 3")
    return g.select("o_custkey", "n", F.array_join(F.transform("p", lambda x: x["o_orderpriority"]), ";").alias("path"))


INDICATORS = ("customers", "silent_customers", "orders", "open_share", "lines", "returned_share", "parts")


@query("""SELECT * FROM (VALUES
    ('customers', (SELECT CAST(count(*) AS DOUBLE) FROM customer)),
    ('silent_customers', (SELECT CAST(count(*) AS DOUBLE) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))),
    ('orders', (SELECT CAST(count(*) AS DOUBLE) FROM orders)),
    ('open_share', (SELECT round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / greatest(count(*), 1), 1) FROM orders)),
    ('lines', (SELECT CAST(count(*) AS DOUBLE) FROM lineitem)),
    ('returned_share', (SELECT round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / greatest(count(*), 1), 1) FROM lineitem)),
    ('parts', (SELECT CAST(count(*) AS DOUBLE) FROM part))) v(indicator, value)""")
def kpi_sheet(t) -> DataFrame:
    """One aggregate a table, then rows of indicator and value."""
    orders, lines = t("orders"), t("lineitem")
    silent = t("customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    one = [
        t("customer").agg(F.count("*").cast("double").alias("customers")), silent.agg(F.count("*").cast("double").alias("silent_customers")),
        orders.agg(F.count("*").cast("double").alias("orders"), percent(F.count_if(F.col("o_orderstatus") == "O"), F.count("*")).alias("open_share")),
        lines.agg(F.count("*").cast("double").alias("lines"), percent(F.count_if(F.col("l_returnflag") == "R"), F.count("*")).alias("returned_share")),
        t("part").agg(F.count("*").cast("double").alias("parts")),
    ]
    wide = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)  # single rows
    return wide.unpivot([], list(INDICATORS), "indicator", "value")


@query("""WITH c AS (SELECT o_custkey, least(sum(o_totalprice), 2000000) AS s, count(*) AS n FROM orders GROUP BY 1),
    b AS (SELECT (s >= 250000)::INT + (s >= 500000)::INT + (s >= 1000000)::INT + (s >= 2000000)::INT AS bucket, n FROM c)
    SELECT CASE WHEN grouping(bucket) = 1 THEN -1 ELSE bucket END AS bucket, CAST(count(*) AS BIGINT) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM b GROUP BY ROLLUP(bucket)""")
def histogram_rollup(t) -> DataFrame:
    sums = t("orders").groupBy("o_custkey").agg(F.least(F.sum("o_totalprice"), F.lit(2_000_000.0)).alias("s"), F.count("*").alias("n"))
    rows = sums.withColumn("bucket", documents.histogram(F.col("s"), [250_000, 500_000, 1_000_000, 2_000_000]))
    total = F.when(F.grouping("bucket") == 1, -1).otherwise(F.col("bucket"))
    return rows.rollup("bucket").agg(total.alias("b"), F.count("*").alias("customers"), F.sum("n").alias("orders")).select(F.col("b").alias("bucket"), "customers", "orders")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O')
    WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def showcase(t) -> DataFrame:
    """The best of each issuer, then the best ten."""
    one = history.latest_per_key(t("orders").filter("o_orderstatus = 'O'"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])
    return one.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, rn, rn > 3 AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END,
    o_orderdate NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def capped_lists(t) -> DataFrame:
    """Three a customer, and two more on its overflow list."""
    order = [F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).asc(), F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey").asc()]
    return history.latest_per_key(t("orders"), ["o_custkey"], order, 5).select("o_custkey", "o_orderkey", "rn", (F.col("rn") > 3).alias("overflow"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2001-05-01' THEN 'full' WHEN o_orderstatus IN ('O', 'P') AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '2001-05-01' THEN 'grace'
    WHEN o_orderstatus = 'F' THEN 'limited' ELSE 'none' END AS access, CAST(greatest(0, ceil(date_diff('second', TIMESTAMP '2001-05-01', o_orderdate) / 86400)) AS INTEGER) AS days FROM orders""")
def entitlements(t) -> DataFrame:
    now = F.lit("2001-05-01").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "past_due").otherwise("trial")
    rows = t("orders").withColumn("s", status)
    return rows.select("o_orderkey", lifecycle.entitlement(F.col("s"), F.col("o_orderdate"), now, 30).alias("access"), lifecycle.days_left(F.col("o_orderdate"), now).alias("days"))


@query("""SELECT o_orderkey, round(least(o_totalprice, 50000) * 0.1 + greatest(0, least(o_totalprice, 150000) - 50000) * 0.05 + greatest(0, least(o_totalprice, 1000000) - 150000) * 0.02, 4) AS benefit FROM orders""")
def tiered_benefit(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.round(lifecycle.tiered(F.col("o_totalprice"), [(50_000, 0.1), (150_000, 0.05), (1_000_000, 0.02)]), 4).alias("benefit"))


@query("""SELECT date_trunc('month', o_orderdate) AS month, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (PARTITION BY year(min(o_orderdate)) ORDER BY date_trunc('month', o_orderdate)) AS BIGINT) AS year_to_date
    FROM orders GROUP BY 1""")
def month_series(t) -> DataFrame:
    months = t("orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.year("month")).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.withColumn("year_to_date", F.sum("n").over(w))
