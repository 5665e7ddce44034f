"""Health of polled sources from their log of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.history import latest_per_key

#: Days between two checks of a source, by its frequency.
INTERVAL_DAYS = {"daily": 1.0, "thrice_weekly": 2.33, "weekly": 7.0, "biweekly": 14.0, "monthly": 30.0}
LEAST_SILENCE_DAYS, ERRORS_FOR_RED, RECENT = 30, 3, 5


def interval_days(frequency: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in INTERVAL_DAYS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, frequency), F.lit(7.0))


def recent_outcomes(checks: DataFrame, n: int = RECENT) -> DataFrame:
    """source_id, outcomes: those of its last n checks, newest first (ties: larger check id first)."""
    last = latest_per_key(checks, ["source_id"], [F.col("started_at").desc(), F.col("check_id").desc()], n)
    rows = last.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("rn", "outcome"))).alias("r"))
    return rows.select("source_id", F.transform("r", lambda x: x["outcome"]).alias("outcomes"))


def leading_run(values: Column, value: str) -> Column:
    """How many elements at the front of an array equal value."""
    stop = F.array_position(F.transform(values, lambda x: x != value), True)
    return F.when(stop == 0, F.size(values)).otherwise(stop - 1).cast("int")


def traffic_light(sources: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """source_id, colour (paused, red, yellow, green), reason, silence_days, threshold_days.

    sources: source_id, frequency, status, paused; checks: source_id, check_id, started_at, outcome, items, news.
    """
    # one aggregate a source, combined before the shuffle; the last outcomes are the largest of a bounded window
    ranked = latest_per_key(checks.select("source_id", "check_id", "started_at", "outcome", "items"), ["source_id"], [F.col("started_at").desc(), F.col("check_id").desc()], RECENT)
    recent = ranked.groupBy("source_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "outcome"))), lambda x: x["outcome"]).alias("outcomes"), F.max(F.when(F.col("rn") == 1, F.col("items"))).alias("last_items")
    )
    news = checks.filter("news > 0").groupBy("source_id").agg(F.max("started_at").alias("last_news"))
    df = sources.join(recent, "source_id", "left").join(news, "source_id", "left")
    last = F.get("outcomes", F.lit(0))
    df = df.withColumns({
        "errors": leading_run(F.col("outcomes"), "error"),
        # in microseconds: whole seconds count a day that lacks a part of a second
        "silence_days": F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_news").cast("timestamp"))) / 1_000_000 / 86400).cast("int"),
        "threshold_days": F.greatest(F.lit(LEAST_SILENCE_DAYS), F.floor(3 * interval_days(F.col("frequency"))).cast("int")),
    })
    rules = [
        (F.col("paused"), "paused", "paused"),
        (F.col("status") == "excluded", "paused", "excluded"),
        (F.col("outcomes").isNull(), "yellow", "never checked"),
        (last == "structure_changed", "red", "structure changed"),
        (F.col("errors") >= ERRORS_FOR_RED, "red", "errors in a row"),
        (F.col("errors") > 0, "yellow", "error at the last check"),
        (last == "skipped", "yellow", "skipped at the last check"),
        (F.col("silence_days") > F.col("threshold_days"), "yellow", "suspicious silence"),
        (F.col("silence_days").isNull() & (F.col("last_items") == 0), "yellow", "answers but nothing is read"),
        (F.col("silence_days").isNull(), "yellow", "no news so far"),
    ]
    colour, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, c, r in rules[1:]:
        colour, reason = colour.when(test, c), reason.when(test, r)
    return df.select("source_id", colour.otherwise("green").alias("colour"), reason.otherwise("regular").alias("reason"), "silence_days", "threshold_days", "errors")


def due(sources: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Sources never checked or last checked a full interval ago."""
    last = checks.groupBy("source_id").agg(F.max("started_at").alias("last_check"))
    df = sources.join(last, "source_id", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("last_check")
    return df.filter(F.col("last_check").isNull() | (age >= interval_days(F.col("frequency")) * 86400))


def structure_changes(checks: DataFrame) -> DataFrame:
    """Checks that read nothing although the check before read something; a first empty check is none."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy("started_at", "check_id")
    return checks.withColumn("before", F.lag("items").over(w)).filter((F.col("items") == 0) & (F.col("before") > 0))


def zero_filled(counts: DataFrame, key: str, values: list[str], count: str = "n") -> DataFrame:
    """Counts with a row for every listed value."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {key} string")
    return F.broadcast(names).join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def without_future(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """Times later than a day from now become null: a wrong clock, not news."""
    return df.withColumn(ts, F.when(F.col(ts) <= now + F.expr("INTERVAL 1 DAY"), F.col(ts)))


def lockout(logins: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """user_id, failures since its last success and within the last minutes."""
    good = logins.filter("ok").groupBy("user_id").agg(F.max("ts").alias("last_ok"))
    bad = logins.filter("NOT ok AND ts IS NOT NULL").join(good, "user_id", "left")
    bad = bad.filter(F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok")))
    return bad.groupBy("user_id").agg(F.count("*").alias("failures"), F.count_if(F.col("ts") > now - F.expr(f"INTERVAL {minutes} MINUTES")).alias("recent"))


def run_ledger(runs: DataFrame, now: Column, limit_hours: int = 3) -> DataFrame:
    """The last run of each job and its status: running, interrupted (started long ago, never ended), failed, done."""
    last = latest_per_key(runs, ["job"], [F.col("started_at").desc(), F.col("run_id").desc()]).drop("rn")
    age = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    status = (
        F.when(F.col("ended_at").isNull() & (age > limit_hours * 3600), "interrupted").when(F.col("ended_at").isNull(), "running")
        .when(~F.coalesce(F.col("ok"), F.lit(False)), "failed").otherwise("done")
    )
    return last.withColumns({"status": status, "seconds": (F.unix_timestamp(F.coalesce("ended_at", now)) - F.unix_timestamp("started_at"))})


def due_backlog(sources: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Sources whose full reading is due: never read well, or not for their interval, and not tried within a day.

    checks: those of full readings, with outcome.
    """
    last = checks.groupBy("source_id").agg(F.max("started_at").alias("last_try"), F.max(F.when(F.col("outcome") == "ok", F.col("started_at"))).alias("last_success"))
    df = sources.join(last, "source_id", "left")
    age = lambda c: F.unix_timestamp(now) - F.unix_timestamp(c)
    due_again = F.col("last_success").isNull() | (age("last_success") >= interval_days(F.coalesce("frequency", F.lit("monthly"))) * 86400 - 3600)
    return df.filter(F.col("last_try").isNull() | (due_again & (age("last_try") >= 23 * 3600)))


def first_read_suppressed(rows: DataFrame, source: str, read_at: str) -> DataFrame:
    """Adds from_backlog: rows of the first reading of their source, which are no news."""
    first = rows.groupBy(source).agg(F.min(read_at).alias("__first"))
    return rows.join(first, source).withColumn("from_backlog", F.col(read_at) == F.col("__first")).drop("__first")


def work_queue(rows: DataFrame, checked: str, tie: str, now: Column, cool_days: int, limit: int) -> DataFrame:
    """The rows never checked, then those checked longest ago, that have cooled down: at most ``limit``, which is the feature."""
    cold = F.col(checked).isNull() | (F.col(checked) < now - F.make_dt_interval(F.lit(cool_days)))
    return rows.filter(cold).orderBy(F.col(checked).asc_nulls_first(), tie).limit(limit)


def job_status(runs: DataFrame, jobs: DataFrame, now: Column, limit_hours: int = 3) -> DataFrame:
    """job and status of every job: never, running, interrupted, late (over half a period, half an hour at least), else failed or done.

    jobs: job, every_seconds.
    """
    last = run_ledger(runs, now, limit_hours).select("job", F.col("status").alias("last_status"), "started_at")
    rows = jobs.join(last, "job", "left")
    slack = F.greatest(F.lit(1800), F.col("every_seconds") / 2)
    late = F.unix_timestamp(now) > F.unix_timestamp("started_at") + F.col("every_seconds") + slack
    status = F.when(F.col("last_status").isNull(), "never").when(F.col("last_status").isin("running", "interrupted"), F.col("last_status")).when(late, "late").otherwise(F.col("last_status"))
    return rows.select("job", status.alias("status"))
