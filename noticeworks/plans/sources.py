"""Health and news of polled sources.

``events`` stands for the log of checks: user_id is the source, ``error`` a failed check, ``purchase`` one with news;
a source's frequency follows from its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.text import iso_week, percent
from noticeworks.operators import health, history
from noticeworks.plans.base import query


def now() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


FREQUENCIES = ["daily", "thrice_weekly", "weekly", "biweekly", "monthly"]

CHECKS_SQL = """
    checks AS (SELECT event_id AS check_id, user_id AS source_id, ts AS started_at,
        CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'skipped' ELSE 'ok' END AS outcome,
        CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INTEGER) % 10 END AS items,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS news FROM events),
    sources AS (SELECT DISTINCT source_id, CASE source_id % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'thrice_weekly' WHEN 2 THEN 'weekly'
        WHEN 3 THEN 'biweekly' ELSE 'monthly' END AS frequency,
        CASE WHEN source_id % 17 = 0 THEN 'excluded' ELSE 'active' END AS status, source_id % 13 = 0 AS paused FROM checks)"""


def checks(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("check_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("started_at"),
        F.when(kind == "error", "error").when(kind == "signup", "skipped").otherwise("ok").alias("outcome"),
        F.when(kind == "error", 0).otherwise(F.floor("value").cast("int") % 10).alias("items"),
        F.when(kind == "purchase", 1).otherwise(0).alias("news"),
    )


def sources(log: DataFrame) -> DataFrame:
    frequency = F.get(F.array(*map(F.lit, FREQUENCIES)), (F.col("source_id") % 5).cast("int"))
    return log.select("source_id").distinct().select(
        "source_id", F.coalesce(frequency, F.lit(FREQUENCIES[-1])).alias("frequency"),
        F.when(F.col("source_id") % 17 == 0, "excluded").otherwise("active").alias("status"), (F.col("source_id") % 13 == 0).alias("paused"),
    )


LIGHT_SQL = f"""
    WITH {CHECKS_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, check_id DESC) AS rn FROM checks),
    run AS (SELECT source_id, coalesce(min(CASE WHEN outcome <> 'error' THEN rn END) - 1, count(*)) AS errors,
        max(CASE WHEN rn = 1 THEN outcome END) AS last, max(CASE WHEN rn = 1 THEN items END) AS last_items FROM ranked WHERE rn <= 5 GROUP BY 1),
    facts AS (SELECT source_id, max(CASE WHEN news > 0 THEN started_at END) AS last_news FROM checks GROUP BY 1),
    j AS (SELECT s.*, r.errors, r.last, r.last_items,
        CAST(floor(date_diff('microsecond', f.last_news, TIMESTAMP '2024-01-31') / 1000000 / 86400) AS INTEGER) AS silence_days,
        greatest(30, CAST(floor(3 * CASE frequency WHEN 'daily' THEN 1 WHEN 'thrice_weekly' THEN 2.33 WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 ELSE 30 END) AS INTEGER)) AS threshold_days
        FROM sources s LEFT JOIN run r USING (source_id) LEFT JOIN facts f USING (source_id)),
    light AS (SELECT source_id,
        CASE WHEN paused OR status = 'excluded' THEN 'paused' WHEN last IS NULL THEN 'yellow' WHEN errors >= 3 THEN 'red' WHEN errors > 0 THEN 'yellow'
             WHEN last = 'skipped' THEN 'yellow' WHEN silence_days > threshold_days THEN 'yellow' WHEN silence_days IS NULL THEN 'yellow' ELSE 'green' END AS colour,
        CASE WHEN paused THEN 'paused' WHEN status = 'excluded' THEN 'excluded' WHEN last IS NULL THEN 'never checked' WHEN errors >= 3 THEN 'errors in a row'
             WHEN errors > 0 THEN 'error at the last check' WHEN last = 'skipped' THEN 'skipped at the last check' WHEN silence_days > threshold_days THEN 'suspicious silence'
             WHEN silence_days IS NULL AND last_items = 0 THEN 'answers but nothing is read' WHEN silence_days IS NULL THEN 'no news so far' ELSE 'regular' END AS reason,
        silence_days, threshold_days, CAST(errors AS INTEGER) AS errors FROM j)"""


@query(f"{LIGHT_SQL} SELECT * FROM light")
def source_health(t) -> DataFrame:
    log = checks(t("events"))
    return health.traffic_light(sources(log), log, now())


@query(f"""{LIGHT_SQL} SELECT c.colour, CAST(count(l.source_id) AS BIGINT) AS n
    FROM (VALUES ('red'), ('yellow'), ('green'), ('paused')) c(colour) LEFT JOIN light l USING (colour) GROUP BY 1""")
def health_summary(t) -> DataFrame:
    log = checks(t("events"))
    lights = health.traffic_light(sources(log), log, now())
    return health.zero_filled(lights.groupBy("colour").agg(F.count("*").alias("n")), "colour", ["red", "yellow", "green", "paused"])


@query(f"""WITH {CHECKS_SQL} SELECT s.source_id, frequency, max(started_at) AS last_check FROM sources s JOIN checks c USING (source_id) GROUP BY 1, 2
    HAVING date_diff('second', max(started_at), TIMESTAMP '2024-01-31') >= 86400 * CASE frequency WHEN 'daily' THEN 1 WHEN 'thrice_weekly' THEN 2.33 WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 ELSE 30 END""")
def due_sources(t) -> DataFrame:
    log = checks(t("events"))
    return health.due(sources(log), log, now()).select("source_id", "frequency", "last_check")


@query("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_event(t) -> DataFrame:
    return history.newest(t("events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query(f"""WITH {CHECKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, check_id DESC) AS rn FROM checks)
    SELECT source_id, string_agg(outcome, ',' ORDER BY rn) AS outcomes FROM r WHERE rn <= 5 GROUP BY 1""")
def last5_outcomes(t) -> DataFrame:
    return health.recent_outcomes(checks(t("events"))).select("source_id", F.array_join("outcomes", ",").alias("outcomes"))


@query(f"""WITH {CHECKS_SQL}, l AS (SELECT *, lag(items) OVER (PARTITION BY source_id ORDER BY started_at, check_id) AS before FROM checks)
    SELECT check_id, source_id, before FROM l WHERE items = 0 AND before > 0""")
def structure_changed(t) -> DataFrame:
    return health.structure_changes(checks(t("events"))).select("check_id", "source_id", "before")


@query("""WITH good AS (SELECT user_id, max(ts) AS last_ok FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id, CAST(count(*) AS BIGINT) AS failures, CAST(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 00:00:00') AS BIGINT) AS recent
    FROM events e LEFT JOIN good USING (user_id) WHERE event_type = 'error' AND (last_ok IS NULL OR ts > last_ok) GROUP BY 1""")
def lockout(t) -> DataFrame:
    log = t("events").filter("event_type IN ('error', 'signup')").select("user_id", "ts", (F.col("event_type") == "signup").alias("ok"))
    return health.lockout(log, now(), 24 * 60)


@query("""SELECT strftime(ts, '%G-W%V') AS week, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS sources
    FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def weekly_news(t) -> DataFrame:
    news = t("events").filter("event_type = 'purchase'").withColumn("week", iso_week(F.col("ts")))
    return news.groupBy("week").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("sources"))


@query("""SELECT week, user_id, event_id FROM (SELECT strftime(ts, '%G-W%V') AS week, user_id, event_id,
    row_number() OVER (PARTITION BY strftime(ts, '%G-W%V'), user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn <= 3""")
def weekly_top_news(t) -> DataFrame:
    news = t("events").filter("event_type = 'purchase'").withColumn("week", iso_week(F.col("ts")))
    return history.latest_per_key(news, ["week", "user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("week", "user_id", "event_id")


def visits(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.to_date("ts"))


@query("""SELECT CAST(ts AS DATE) AS day, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views,
    CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(count(DISTINCT user_id) AS BIGINT) AS visitors FROM events GROUP BY 1""")
def visit_report_daily(t) -> DataFrame:
    kind = F.col("event_type")
    return visits(t("events")).groupBy("day").agg(
        F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("clicks"), F.count_distinct("user_id").alias("visitors")
    )


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS BIGINT) AS last_7,
    round(100.0 * count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') / greatest(count(*), 1), 1) AS share FROM events GROUP BY 1""")
def visit_report_type(t) -> DataFrame:
    recent = F.count_if(F.col("ts") >= "2024-01-24")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), recent.alias("last_7"), percent(recent, F.count("*")).alias("share"))


@query("""WITH p AS (SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS now_n,
        count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16' AND ts >= TIMESTAMP '2024-01-01') AS before_n FROM events GROUP BY 1)
    SELECT event_type, CAST(now_n AS BIGINT) AS now_n, CAST(before_n AS BIGINT) AS before_n,
        CASE WHEN before_n > 0 THEN round(100.0 * (now_n - before_n) / before_n, 1) END AS change FROM p""")
def period_comparison(t) -> DataFrame:
    ts = F.col("ts")
    sums = t("events").groupBy("event_type").agg(F.count_if(ts >= "2024-01-16").alias("now_n"), F.count_if((ts < "2024-01-16") & (ts >= "2024-01-01")).alias("before_n"))
    return sums.withColumn("change", F.when(F.col("before_n") > 0, F.round(F.lit(100.0) * (F.col("now_n") - F.col("before_n")) / F.col("before_n"), 1)))


@query("""WITH refs AS (SELECT user_id, min(ts) + INTERVAL 10 DAY AS ref FROM events GROUP BY 1),
    v AS (SELECT r.user_id, r.ref, e.event_id, e.ts, row_number() OVER (PARTITION BY r.user_id, r.ref ORDER BY e.ts, e.event_id) AS rn
          FROM refs r LEFT JOIN events e ON e.user_id = r.user_id AND e.ts > r.ref)
    SELECT user_id, ref, event_id, ts AS saved_at FROM v WHERE rn = 1""")
def asof_version(t) -> DataFrame:
    events = t("events").select("user_id", "event_id", "ts")
    refs = events.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("ref"))
    found = history.first_after(refs, events, "user_id", "ref", "ts", "event_id")
    return found.select("user_id", "ref", F.col("version.event_id").alias("event_id"), F.col("version.ts").alias("saved_at"))


@query("""WITH refs AS (SELECT user_id, min(ts) + INTERVAL 10 DAY AS ref FROM events GROUP BY 1),
    a AS (SELECT r.user_id, arg_min(e.event_type, (e.ts, e.event_id)) AS after_type FROM refs r JOIN events e ON e.user_id = r.user_id AND e.ts > r.ref GROUP BY 1),
    n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS now_type, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, concat_ws(',', CASE WHEN after_type IS DISTINCT FROM now_type THEN 'state' END, CASE WHEN now_type = 'error' THEN 'failed' END,
        CASE WHEN n > 70 THEN 'busy' END) AS changes FROM n LEFT JOIN a USING (user_id)""")
def delta_feed(t) -> DataFrame:
    """Typed changes of each entity between a reference time and now."""
    events = t("events").select("user_id", "event_id", "ts", "event_type")
    refs = events.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("ref"))
    then = history.first_after(refs, events, "user_id", "ref", "ts", "event_id").select("user_id", F.col("version.event_type").alias("after_type"))
    now = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("now_type"), F.count("*").alias("n"))
    rows = now.join(then, "user_id", "left")
    changes = F.array_compact(F.array(
        F.when(~F.col("after_type").eqNullSafe(F.col("now_type")), "state"), F.when(F.col("now_type") == "error", "failed"), F.when(F.col("n") > 70, "busy"),
    ))
    return rows.select("user_id", F.array_join(changes, ",").alias("changes"))


@query("""SELECT event_type, k, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k')) WHERE k >= 50 GROUP BY 1, 2""")
def json_filter(t) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").withColumn("k", k).filter("k >= 50").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS cost, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed FROM events GROUP BY 1""")
def cost_series(t) -> DataFrame:
    return visits(t("events")).groupBy("day").agg(F.round(F.sum("value"), 4).alias("cost"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT day, event_type AS indicator, CAST(n AS BIGINT) AS n, CAST(lag(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS before FROM d""")
def indicator_trend(t) -> DataFrame:
    from pyspark.sql import Window

    daily = visits(t("events")).groupBy("day", F.col("event_type").alias("indicator")).agg(F.count("*").alias("n"))
    return daily.withColumn("before", F.lag("n").over(Window.partitionBy("indicator").orderBy("day")))


@query("""WITH r AS (SELECT user_id AS job, event_id, ts AS started_at, CASE WHEN event_type <> 'view' THEN ts + to_milliseconds(CAST(floor(value) AS BIGINT) * 1000) END AS ended_at,
        event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT job, event_id AS run_id, CASE WHEN ended_at IS NULL AND date_diff('second', started_at, TIMESTAMP '2024-01-31') > 10800 THEN 'interrupted'
        WHEN ended_at IS NULL THEN 'running' WHEN NOT ok THEN 'failed' ELSE 'done' END AS status FROM r WHERE rn = 1""")
def run_ledger(t) -> DataFrame:
    runs = t("events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"),
        F.when(F.col("event_type") != "view", F.timestamp_seconds(F.unix_timestamp("ts") + F.floor("value"))).alias("ended_at"), (F.col("event_type") != "error").alias("ok"),
    )
    return health.run_ledger(runs, now()).select("job", "run_id", "status")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, max(ts) AS last_ts FROM events GROUP BY 1
    HAVING max(ts) - min(ts) > INTERVAL 25 DAY AND count(DISTINCT event_type) >= 4 AND bool_or(event_type = 'signup')""")
def long_lived_sources(t) -> DataFrame:
    kind = F.col("event_type")
    g = t("events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(kind == "error").alias("errors"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"),
        F.count_distinct("event_type").alias("kinds"), F.bool_or(kind == "signup").alias("signed"),
    )
    return g.filter("last_ts - first_ts > INTERVAL '25' DAY AND kinds >= 4 AND signed").select("user_id", "n", "errors", "last_ts")


@query("""SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('click', 'view')) WHERE rn BETWEEN 11 AND 20""")
def paged_list(t) -> DataFrame:
    """The second page of ten of two lists."""
    rows = t("events").filter("event_type IN ('click', 'view')")
    return history.latest_per_key(rows, ["event_type"], [F.col("ts"), F.col("event_id")], 20).filter("rn > 10").select("user_id", "ts", "event_id")


CUTS = ["2024-01-11", "2024-01-21", "2024-01-31"]

VERSIONS_SQL = f"""
    cuts AS (SELECT unnest([{", ".join(f"DATE '{c}'" for c in CUTS)}]) AS cut),
    states AS (SELECT user_id, cut, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS seen FROM events JOIN cuts ON ts < cut GROUP BY ALL),
    grid AS (SELECT u.user_id, c.cut, CASE WHEN s.kind <> 'signup' THEN s.kind END AS kind, s.seen FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN cuts c
        LEFT JOIN states s ON s.user_id = u.user_id AND s.cut = c.cut),
    steps AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY cut) AS before FROM grid),
    changes AS (SELECT *, lead(cut) OVER (PARTITION BY user_id ORDER BY cut) AS until FROM steps WHERE kind IS DISTINCT FROM before),
    log AS (SELECT user_id, kind, seen, row_number() OVER (PARTITION BY user_id ORDER BY cut) AS version, cut AS valid_from, until AS valid_to FROM changes WHERE kind IS NOT NULL)"""


def source_versions(events: DataFrame) -> DataFrame:
    """The log of each source's last event after three readings; a source whose last event is a signup is not listed."""

    def state(cut: str) -> DataFrame:
        read = events.filter(F.col("ts") < F.lit(cut).cast("timestamp_ntz")).groupBy("user_id")
        return read.agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("seen")).filter("kind <> 'signup'")

    day = lambda cut: F.lit(cut).cast("date")
    log = history.version_log(state(CUTS[0]), "user_id", day(CUTS[0]))
    for cut in CUTS[1:]:
        log = history.next_versions(log, state(cut), "user_id", ["kind"], day(cut), complete=True)
    return log


@query(f"WITH {VERSIONS_SQL} SELECT user_id, kind, version, valid_from FROM log WHERE valid_from <= DATE '2024-01-25' AND (valid_to IS NULL OR valid_to > DATE '2024-01-25')")
def version_as_of(t) -> DataFrame:
    """What was known of each source on a day."""
    return history.as_of(source_versions(t("events")), F.lit("2024-01-25").cast("date")).select("user_id", "kind", "version", "valid_from")


@query(f"WITH {VERSIONS_SQL} SELECT user_id, kind, version, valid_from, valid_to FROM log WHERE version = 2")
def version_by_number(t) -> DataFrame:
    """The second version of each source that has one."""
    return history.at_version(source_versions(t("events")), 2).select("user_id", "kind", "version", "valid_from", "valid_to")
