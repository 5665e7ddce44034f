"""Calls as offers: what they are worth, their orders, a company's view, and loading them with their sources.

Columns of an offer: kinds (array), kind (where there is one only), grant_max, contribution_max, loan_max, percent,
percent_grant, deadline; matched ones also level, out_of_zone, doubts, heavy_doubts, interests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.matching import COMPATIBLE, TO_VERIFY, relevance

# Kinds of aid that need not be paid back, kinds without money, ranks of the other kinds.
NON_REPAYABLE = ("fondo_perduto", "voucher", "premio")
NO_MONEY = ("servizi", "altro")
KIND_RANKS = {"credito_imposta": 1, "finanziamento_agevolato": 2, "garanzia": 3}
SOON_DAYS, NEW_DAYS = 15, 7

#: Beginning of a doubt -> what a company is told (the first that fits; None: the doubt itself).
PLAIN = [
    ("activity code missing", "give the activity code: it tells whether your sector is admitted"),
    ("activity excluded in another version", "make sure that your sector is not excluded"),
    ("activity", "check the activity code"), ("activities", "check the activity code"), ("only a part of the activity", "check the activity code"),
    ("territory unknown, call of another region", None), ("territory", "check where the call applies"), ("no site", "give the company's site"),
    ("subject missing", "tell whether you are a company, a freelancer or a body"), ("subjects", "check whether you are among the beneficiaries"), ("other subjects", "check whether you are among the beneficiaries"),
    ("legal form missing", "give the legal form"), ("forms", "check the admitted legal form"), ("other forms", "check the admitted legal form"),
    ("size missing", "give the company's size (staff and turnover)"), ("size depends", "check the size (the balance sheet counts)"), ("sizes", "check the admitted size"),
    ("age", "check the company's age"), ("founding date missing", "give the founding date"), ("requirement", "check a requirement of the call"),
    ("range unknown", "check staff and turnover"), ("state unknown", "check whether the call is open: dates are missing"), ("summary only", "read the official call"), ("no document read", "read the official call"),
]


def truthy(amount: str) -> Column:
    """Whether an amount is there and not zero."""
    return F.coalesce(F.col(amount) != 0, F.lit(False))


def all_kinds() -> Column:
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    return F.when(F.col("kind").isNotNull() & (F.col("kind") != ""), F.array_union(kinds, F.array("kind"))).otherwise(kinds)


def non_repayable() -> Column:
    return truthy("grant_max") | F.arrays_overlap(all_kinds(), F.array(*map(F.lit, NON_REPAYABLE)))


def second_rank() -> Column:
    """Aid without money: services, recognition."""
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    own = F.when(F.size(kinds) > 0, kinds).otherwise(all_kinds())
    return (F.size(own) > 0) & F.forall(own, lambda k: k.isin(*NO_MONEY)) & ~non_repayable()


def benefit() -> Column:
    """The most that a company may get: the grant, or the contribution where it is one; null for loans and guarantees."""
    contribution = truthy("contribution_max") & (non_repayable() | F.arrays_overlap(all_kinds(), F.array(F.lit("credito_imposta"), F.lit("misto"))))
    return F.when(truthy("grant_max"), F.col("grant_max")).when(contribution, F.col("contribution_max"))


def kind_rank() -> Column:
    """0 non-repayable, 1 tax credit, 2 loan, 3 guarantee, 4 other, 5 without money."""
    table = F.create_map(*[F.lit(x) for pair in KIND_RANKS.items() for x in pair])
    best = F.array_min(F.transform(all_kinds(), lambda k: F.coalesce(F.try_element_at(table, k), F.lit(4))))
    return F.when(second_rank(), 5).when(non_repayable(), 0).otherwise(F.coalesce(best, F.lit(4)))


def ordered_by(criterion: str, tie: str) -> list[Column]:
    """relevance, or deadline, benefit or kind with relevance among equals."""
    first = {
        "relevance": [], "deadline": [F.col("deadline").asc_nulls_last()], "benefit": [benefit().desc_nulls_last()], "kind": [kind_rank().asc()],
    }[criterion]
    return [*first, *relevance(tie)]


def non_repayable_first(tie: str) -> list[Column]:
    """Within each level what need not be paid back first and what is no money last, else as by relevance."""
    level = F.when(F.col("level") == COMPATIBLE, 0).when(F.col("level") == TO_VERIFY, 1).otherwise(2)
    return [level.asc(), second_rank().asc(), non_repayable().desc(), *relevance(tie)]


def group() -> Column:
    """suitable, to_weigh, or elsewhere."""
    return F.when(F.col("level") == COMPATIBLE, "suitable").when(F.col("out_of_zone"), "elsewhere").otherwise("to_weigh")


def my_calls_order(tie: str) -> list[Column]:
    place = F.when(F.col("level") == COMPATIBLE, 0).when(F.col("out_of_zone"), 2).otherwise(1)
    return [place.asc(), second_rank().asc(), non_repayable().desc(), F.col("deadline").asc_nulls_last(), *relevance(tie)]


def proposal_order(tie: str) -> list[Column]:
    """Compatible first, own zone first, non-repayable first by amount and percentage, then the nearest deadline."""
    amount = F.when(truthy("grant_max"), F.col("grant_max")).when(non_repayable() & truthy("contribution_max"), F.col("contribution_max")).otherwise(0)
    nonzero = lambda c: F.nullif(F.col(c), F.lit(0))
    share = F.when(non_repayable(), F.coalesce(nonzero("percent_grant"), nonzero("percent"), F.lit(0))).otherwise(0)
    return [(F.col("level") != COMPATIBLE).asc(), F.col("out_of_zone").asc(), non_repayable().desc(), amount.desc(), share.desc(), F.col("deadline").asc_nulls_last(), *relevance(tie)]


def within_days(deadline: Column, today: Column, days: int) -> Column:
    """From today on, so many days at most, both ends included; false without a deadline."""
    return F.coalesce(deadline.between(today, F.date_add(today, days)), F.lit(False))


def plain(doubt: Column) -> Column:
    out = F.when(F.lit(False), doubt)
    for start, words in PLAIN:
        out = out.when(doubt.startswith(start), doubt if words is None else F.lit(words))
    return out.otherwise(doubt)


def company_view(matched: DataFrame, today: Column) -> DataFrame:
    """Adds group, plain_doubts, why, days_left, soon, new (a card not older than NEW_DAYS; needs card_on) to matched calls."""
    doubts = F.array_distinct(F.transform("doubts", plain))
    favours = F.slice(F.filter("favours", lambda f: f != "bonus requirement"), 1, 3)
    why = F.when(F.col("level") == COMPATIBLE, F.when(F.size(favours) > 0, F.concat(F.lit("requirements met: "), F.array_join(favours, "; "))).otherwise("nothing excludes the company"))
    why = why.otherwise(F.coalesce(F.get("plain_doubts", F.lit(0)), F.lit("to be checked in the official call")))
    left = F.datediff("deadline", today)
    return matched.withColumn("plain_doubts", doubts).withColumns({
        "group": group(), "why": why, "days_left": left, "soon": F.coalesce(left.between(0, SOON_DAYS), F.lit(False)),
        "new": F.coalesce(F.datediff(today, "card_on") < NEW_DAYS, F.lit(False)),
    })


def view_counts(view: DataFrame, by: str) -> DataFrame:
    count = lambda test: F.count_if(test)
    groups = {g: count(F.col("group") == g).alias(g) for g in ("suitable", "to_weigh", "elsewhere")}
    return view.groupBy(by).agg(*groups.values(), count(F.col("soon")).alias("soon"), count(F.col("new")).alias("new"))


def with_sources(calls: DataFrame, announcements: DataFrame, sources: DataFrame, aggregators: list[str], regions: list[str]) -> DataFrame:
    """calls with levels, territories and regions of the sources of their announcements.

    Aggregators republish calls of any level: theirs counts only where a call has no other source.  announcements:
    call_id, source_id; sources: source_id, level, territory.  Calls that were merged (merged_into) are left out.
    """
    own = F.when(~F.col("source_id").isin(*aggregators), F.col("level"))
    every = announcements.join(sources, "source_id").groupBy("call_id").agg(
        F.array_sort(F.collect_set(own)).alias("own"), F.array_sort(F.collect_set("level")).alias("any"), F.array_sort(F.collect_set("territory")).alias("territories")
    )
    none = F.array().cast("array<string>")
    rows = calls.filter("merged_into IS NULL").join(every, "call_id", "left")
    levels = F.coalesce(F.when(F.size("own") > 0, F.col("own")), F.col("any"), none)
    territories = F.coalesce("territories", none)
    return rows.withColumns({"levels": levels, "territories": territories, "source_regions": F.filter(territories, lambda t: t.isin(*regions))}).drop("own", "any")


def size_from_bands(staff: Column, turnover: Column) -> Column:
    """The larger of the classes that the declared bands tell; null without either."""
    # fixed values: bands and their class (0 micro to 3 large)
    by_staff = F.create_map(*[F.lit(x) for x in ("0", 0, "1-9", 0, "10-49", 1, "50-249", 2, "250+", 3)])
    by_turnover = F.create_map(*[F.lit(x) for x in ("fino_2m", 0, "2m-10m", 1, "10m-50m", 2, "oltre_50m", 3)])
    rank = F.greatest(F.try_element_at(by_staff, staff), F.try_element_at(by_turnover, turnover))
    return F.get(F.array(*map(F.lit, ("micro", "small", "medium", "large"))), rank)
