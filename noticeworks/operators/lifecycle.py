"""States, phases and entitlements that follow from dates and flags by ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(rules: list[tuple[Column, str | None]], default: str | None = None) -> Column:
    """The value of the first rule that holds: an ordered CASE."""
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(F.lit(default))


def state_from_dates(opens: Column, deadline: Column, closed_on: Column, today: Column) -> Column:
    """closed (early, or past its deadline), coming, open, or null without any date."""
    return first_of([
        (closed_on <= today, "closed"), (deadline < today, "closed"), (opens > today, "coming"),
        (opens.isNotNull() | deadline.isNotNull(), "open"),
    ])


def auto_close(calls: DataFrame, notices: DataFrame, today: Column, recent_days: int = 120) -> DataFrame:
    """closed_on by the earliest closing notice of the last recent_days, not before opening, not in the future."""
    n = notices.filter((F.col("role") == "closure") & (F.col("day") <= today) & (F.col("day") >= F.date_sub(today, recent_days)))
    hits = calls.select("call_id", "opens").join(n, "call_id").filter(F.col("opens").isNull() | (F.col("day") >= F.col("opens")))
    first = hits.groupBy("call_id").agg(F.min_by("notice_id", F.struct("day", "notice_id")).alias("notice_id"), F.min("day").alias("notice_day"))
    return calls.join(first, "call_id", "left").withColumn("closed_on", F.coalesce("closed_on", "notice_day")).drop("notice_day")


def mark_stale(calls: DataFrame, notices: DataFrame, roles: tuple[str, ...] = ("extension", "amendment", "faq")) -> DataFrame:
    """stale: the kinds of notice that came after the call's card was written, or null."""
    n = calls.select("call_id", "card_at").join(notices.filter(F.col("role").isin(*roles)), "call_id").filter("linked_at > card_at")
    kinds = n.groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("stale"))
    return calls.join(kinds, "call_id", "left")


def card_errors(rows: DataFrame) -> Column:
    """Failed checks of a structured card, in order."""
    checks = [
        (F.col("opens") > F.col("deadline"), "opens after deadline"),
        (F.col("staff_min") > F.col("staff_max"), "staff range"),
        (F.col("turnover_min") > F.col("turnover_max"), "turnover range"),
        (F.col("age_min") > F.col("age_max"), "age range"),
        (~F.col("percent").between(0, 100), "percentage"),
        (F.col("spend_min") > F.col("spend_max"), "spend range"),
        (F.col("amount") < 0, "negative amount"),
    ]
    known = set(rows.columns)
    usable = [F.when(test, reason) for test, reason in checks if all(c in known for c in _names(reason))]
    return F.filter(F.array(*usable), lambda x: x.isNotNull())


def _names(reason: str) -> list[str]:
    return {
        "opens after deadline": ["opens", "deadline"], "staff range": ["staff_min", "staff_max"], "turnover range": ["turnover_min", "turnover_max"],
        "age range": ["age_min", "age_max"], "percentage": ["percent"], "spend range": ["spend_min", "spend_max"], "negative amount": ["amount"],
    }[reason]


def entitlement(status: Column, ends: Column, now: Column, grace_days: int = 3) -> Column:
    """full, grace, limited or none from a subscription's status and end."""
    day = F.make_dt_interval(F.lit(grace_days))
    return first_of([
        ((status == "active") & (ends.isNull() | (ends >= now)), "full"),
        (status.isin("active", "past_due") & (ends + day >= now), "grace"),
        (status == "trial", "limited"),
    ], "none")


def days_left(ends: Column, now: Column) -> Column:
    """Whole days that are left, a begun day counting."""
    return F.greatest(F.lit(0), F.ceil((F.unix_timestamp(ends) - F.unix_timestamp(now)) / 86400)).cast("int")


def tiered(amount: Column, tiers: list[tuple[float, float]]) -> Column:
    """Sum over tiers (upper bound, rate) of what of the amount lies in each."""
    total, low = F.lit(0.0), 0.0
    for high, rate in tiers:
        total = total + F.greatest(F.lit(0.0), F.least(amount, F.lit(high)) - F.lit(low)) * rate
        low = high
    return total
