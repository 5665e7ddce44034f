"""Version logs and covering samples against sequential rules in plain Python."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from noticeworks.operators import documents, history

DAYS = [dt.date(2024, 1, d) for d in (1, 5, 9, 20)]


def merged(log, state, day, complete):
    """log: {key: [[version, value, clock, from, to]]}, changed in place."""
    for k, (value, clock) in state.items():
        last = log.setdefault(k, [])[-1:] or [None]
        if last[0] and last[0][4] is None:
            if last[0][1] == value:
                continue
            last[0][4] = day
        log[k].append([len(log[k]) + 1, value, clock, day, None])
    if complete:
        for k, versions in log.items():
            if k not in state and versions[-1][4] is None:
                versions[-1][4] = day


@pytest.mark.parametrize("complete", [False, True])
def test_log_of_four_states(spark, complete):
    rng = random.Random(3)
    schema = "k int, value string, clock int"
    want, log, row_counts = {}, None, []
    for i, day in enumerate(DAYS):
        state = {k: (rng.choice(["a", "b", None]), i * 100 + k) for k in range(40) if rng.random() < 0.7}
        merged(want, state, day, complete)
        df = spark.createDataFrame([(k, *v) for k, v in state.items()] + [(None, "x", 1)], schema)
        at = F.lit(day)
        log = history.version_log(df, "k", at) if log is None else history.next_versions(log, df, "k", ["value"], at, complete)
        row_counts.append(log.count())
    got = sorted(tuple(r) for r in log.select("k", "version", "value", "clock", "valid_from", "valid_to").collect())
    assert got == sorted((k, *v) for k, versions in want.items() for v in versions)
    assert row_counts == sorted(row_counts)
    for day in (DAYS[1], dt.date(2024, 1, 10), dt.date(2023, 1, 1)):
        held = {(k, v[0]) for k, versions in want.items() for v in versions if v[3] <= day and (v[4] is None or v[4] > day)}
        assert {(r.k, r.version) for r in history.as_of(log, F.lit(day)).collect()} == held
    assert {r.k for r in history.at_version(log, 3).collect()} == {k for k, v in want.items() if len(v) >= 3}


def test_same_state_again_changes_nothing_and_empty_states(spark):
    schema = "k int, value string"
    df, none = spark.createDataFrame([(1, "a"), (2, None)], schema), spark.createDataFrame([], schema)
    log = history.version_log(df, "k", F.lit(DAYS[0]))
    again = history.next_versions(log, df, "k", ["value"], F.lit(DAYS[1]))
    assert sorted(again.collect()) == sorted(log.collect())
    assert {r.valid_to for r in history.next_versions(log, none, "k", ["value"], F.lit(DAYS[1]), complete=True).collect()} == {DAYS[1]}
    begun = history.next_versions(history.version_log(none, "k", F.lit(DAYS[0])), df, "k", ["value"], F.lit(DAYS[1]))
    assert sorted((r.k, r.version, r.valid_from) for r in begun.collect()) == [(1, 1, DAYS[1]), (2, 1, DAYS[1])]


def picked(rows):
    """The picks one after the other: {key: why}."""
    digest = lambda r: (hashlib.md5(f"s{r[0]}".encode()).hexdigest(), r[0])
    out = {}
    for stratum in {r[1] for r in rows}:
        inside = sorted((r for r in rows if r[1] == stratum), key=digest)
        for why, fits in (("relevant", lambda r: (r[3] or 0) > 0), ("any", lambda r: r[0] not in out)):
            hit = next((r for r in inside if fits(r)), None)
            if hit:
                out[hit[0]] = why
    seen = {r[2] for r in rows if r[0] in out}
    for platform in {r[2] for r in rows if r[2]} - seen:
        inside = [r for r in rows if r[2] == platform]
        if len(inside) >= 2:
            out[min(inside, key=lambda r: ((r[3] or 0) <= 0, digest(r)))[0]] = "platform"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cover_equals_sequential_picks(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y", None, "z"] if i % 9 else ["rare"]), rng.choice(["", None, *map(str, range(30))]), rng.choice([None, 0, 0, 0, 2])) for i in range(120 if seed else 1)]
    df = spark.createDataFrame(rows, "id int, stratum string, platform string, hits int").repartition(3)
    got = {r.id: r.why for r in documents.covering_sample(df, ["stratum"], "platform", "id", "hits", "s").collect()}
    assert got == picked(rows)
    assert documents.covering_sample(df.limit(0), ["stratum"], "platform", "id", "hits", "s").count() == 0
