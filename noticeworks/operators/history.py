"""Latest rows, as-of lookups and changes of keyed tables, as set transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in this order, with their number ``rn``; ties must be broken by the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def newest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The whole row with the largest ``by`` of each key: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("row"))
    return best.select(*keys, "row.*")


def first_after(refs: DataFrame, versions: DataFrame, key: str, ref_time: str, time: str, tie: str) -> DataFrame:
    """As-of join: with each reference row the first version of its key later than its time, or nulls.

    Both lie in one stream a key, newest first, and each reference takes the version just before it there: a sort and
    no product of references and versions.  Repeated references are answered each.
    """
    none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType)
    r = refs.select(F.col(key).alias("__key"), F.col(ref_time).alias("__time"), F.lit(1).alias("__kind"), F.lit(None).cast(versions.schema[tie].dataType).alias("__tie"), F.struct(*refs.columns).alias("ref"), none(versions).alias("version"))
    v = versions.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.lit(2).alias("__kind"), F.col(tie).alias("__tie"), none(refs).alias("ref"), F.struct(*versions.columns).alias("version"))
    # at one time a reference stands before the versions of that time, which are no later than it
    order = Window.partitionBy("__key").orderBy(F.col("__time").desc(), "__kind", F.col("__tie").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = r.unionByName(v.filter(F.col(f"version.{time}").isNotNull())).withColumn("version", F.last("version", ignorenulls=True).over(order)).filter("__kind = 1")
    usable = F.col("__key").isNotNull() & F.col("__time").isNotNull()
    return found.select("ref.*", F.when(usable, F.col("version")).alias("version"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], compare: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """old merged with new: rows whose ``compare`` differs are replaced; ``action`` tells insert, update or unchanged.

    Columns in keep_if_null keep their old value where the new one is null.  Keys are unique on either side.
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = o.withColumn("__o", F.lit(True)).alias("o").join(n.withColumn("__n", F.lit(True)).alias("n"), on, "full")
    action = (
        F.when(F.col("__o").isNull(), "insert")
        .when(F.col("__n").isNotNull() & ~F.col(f"o.{compare}").eqNullSafe(F.col(f"n.{compare}")), "update")
        .otherwise("unchanged")
    )
    both = both.withColumn("action", action)
    take = F.col("action").isin("insert", "update")
    out = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            value = F.coalesce(f"n.{c}", f"o.{c}") if c in keep_if_null else F.col(f"n.{c}")
            out.append(F.when(take, value).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out, "action")


def guarded_merge(old: DataFrame, new: DataFrame, key: str, owner: str, automatic: str) -> DataFrame:
    """new wins over old only where old was decided automatically."""
    cols = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*cols).alias("o")).join(new.select(key, F.struct(*cols).alias("n")), key, "full")
    keep_old = F.col("o").isNotNull() & (F.col("n").isNull() | ~F.col(f"o.{owner}").eqNullSafe(F.lit(automatic)))
    chosen = F.when(keep_old, F.col("o")).otherwise(F.col("n"))
    return both.select(key, chosen.alias("row")).select(key, "row.*")


def archived_versions(old: DataFrame, new: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """The old rows whose tracked columns changed: what a history table gains; other columns (clocks) do not count."""
    n = new.select(key, F.struct(*tracked).alias("__new"))
    return old.join(n, key).filter(~F.struct(*tracked).eqNullSafe(F.col("__new"))).drop("__new")


def version_log(state: DataFrame, key: str, at: Column) -> DataFrame:
    """The first log of a table: every row as version 1, valid from ``at`` on.

    A log holds, beside the table's columns, ``version`` (from 1 for each key), ``valid_from`` and ``valid_to`` (null:
    still valid); a version holds from valid_from until before valid_to.  Rows with a null key have no versions.
    """
    return state.filter(F.col(key).isNotNull()).withColumns({"version": F.lit(1).cast("long"), "valid_from": at, "valid_to": F.lit(None).cast(state.select(at.alias("x")).schema["x"].dataType)})


def next_versions(log: DataFrame, state: DataFrame, key: str, tracked: list[str], at: Column, complete: bool = False) -> DataFrame:
    """The log after another state of the table (one row a key), read at ``at``, later than all before.

    Where a tracked column differs (nulls being equal) the open version ends at ``at`` and the next number begins;
    otherwise it stays as it is, columns that are not tracked (clocks) included.  New keys begin with version 1, and
    keys that come back after an end take their next number.  Keys that state lacks stay open, or end with
    complete=True.  Closed versions are never touched; numbers need each key's last version only, so one join on the
    key, to which log and state bring a row a key each.
    """
    columns = [c for c in log.columns if c not in ("version", "valid_from", "valid_to")]
    newest_first = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), "version").alias("last"))
    both = newest_first.join(state.filter(F.col(key).isNotNull()).select(key, F.struct(*columns).alias("new")), key, "full")
    was_open = F.col("last").isNotNull() & F.col("last.valid_to").isNull()
    same = F.struct(*[F.col(f"last.{c}") for c in tracked]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in tracked]))
    ends = was_open & F.lit(complete) & F.col("new").isNull() | was_open & F.col("new").isNotNull() & ~same
    begins = F.col("new").isNotNull() & (~F.coalesce(was_open, F.lit(False)) | ~same)
    row = lambda of, **more: F.struct(*[more[c].alias(c) if c in more else F.col(f"{of}.{c}").alias(c) for c in log.columns])
    none = F.lit(None).cast(log.schema["valid_to"].dataType)
    old = F.when(was_open, row("last", valid_to=F.when(ends, at).otherwise(none)))
    new = F.when(begins, row("new", version=F.coalesce(F.col("last.version"), F.lit(0).cast("long")) + 1, valid_from=at, valid_to=none))
    changed = both.select(F.explode(F.array_compact(F.array(old, new))).alias("row")).select("row.*")
    return log.filter("valid_to IS NOT NULL").unionByName(changed)


def as_of(log: DataFrame, time: Column) -> DataFrame:
    """The table as it was at a time."""
    return log.filter((F.col("valid_from") <= time) & (F.col("valid_to").isNull() | (F.col("valid_to") > time)))


def at_version(log: DataFrame, number: int) -> DataFrame:
    """Each key's version of that number, where it has one."""
    return log.filter(F.col("version") == number)


def only_new(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the ledger does not have, one each: an idempotent append."""
    return rows.dropDuplicates(keys).join(ledger.select(*keys).distinct(), keys, "left_anti")


def incremented(counters: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters with changes added: one pass over both, combined before the shuffle."""
    return counters.unionByName(changes).groupBy(*keys).agg(F.sum(value).alias(value))


def without_orphans(parents: DataFrame, children: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Parents that some child still refers to."""
    return parents.join(children.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def replaced_keeping(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """new over old by key, the columns in kept staying as they were; rows that only old has stay."""
    o, n = old.select(key, F.struct(*old.columns).alias("o")), new.select(key, F.struct(*new.columns).alias("n"))
    both = o.join(n, key, "full")
    column = lambda c: F.when(F.col("n").isNull() | (F.col("o").isNotNull() & F.lit(c in kept)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(key, *[column(c).alias(c) for c in old.columns if c != key])


def overridden(decisions: DataFrame, corrections: DataFrame, key: str, person: str) -> DataFrame:
    """decisions (outcome, decided_by, proposed) with a person's corrections (outcome); proposed keeps the first automatic outcome."""
    c = corrections.select(key, F.col("outcome").alias("__new"))
    rows = decisions.join(c, key, "full")
    hit, automatic = F.col("__new").isNotNull(), F.col("decided_by") != person
    return rows.select(
        key, F.coalesce("__new", "outcome").alias("outcome"), F.when(hit, person).otherwise(F.col("decided_by")).alias("decided_by"),
        F.when(hit & automatic, F.col("outcome")).otherwise(F.col("proposed")).alias("proposed"),
    )


def merged_json(a: Column, b: Column) -> Column:
    """Two JSON objects as one, b's fields winning; values keep their kind."""
    of = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    theirs = of(b)
    return F.to_json(F.map_concat(F.map_filter(of(a), lambda k, v: ~F.map_contains_key(theirs, k)), theirs))
