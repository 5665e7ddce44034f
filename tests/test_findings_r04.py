"""What the findings of round 4 were about, case by case."""

import random
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from noticeworks.operators import linking

SCHEMA = "id long, source string, issuer string, territory string, urls array<string>, code string, title string, seen long"


def near_copies(n, seed=1):
    """n titles of 14 words, of which two differ from a common one."""
    r, words = random.Random(seed), [f"parola{k}" for k in range(14)]
    out = []
    for _ in range(n):
        title = list(words)
        for at in r.sample(range(14), 2):
            title[at] = f"altro{r.randrange(200)}"
        out.append(" ".join(title))
    return out


def test_linking_makes_no_pairs_of_near_copies(spark):
    """The largest table that is made on the way holds some rows a title, not all pairs of a group (720,000 here)."""
    folder = Path(re.sub("^file:/*", "/", spark.conf.get("spark.checkpoint.dir"))) / "noticeworks"
    before = set(folder.glob("*"))
    rows = [(i, f"s{i % 5}", "x", "ITA", [], None, title, i) for i, title in enumerate(near_copies(1200))]
    out = linking.link_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 1200 and {r.how for r in out} == {"new", "doubt"}
    made = [sum(pq.read_metadata(f).num_rows for f in d.glob("*.parquet")) for d in set(folder.glob("*")) - before]
    assert max(made) <= 20 * 1200


def parts_of(edges, nodes):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {x: top(x) for x in nodes}


@pytest.mark.parametrize("listed", [50_000, 7])
def test_title_edges_connect_what_is_alike(spark, monkeypatch, listed):
    """The components of all pairs, also where long lists are dealt in parts."""
    monkeypatch.setattr(linking, "LISTED", listed)
    r = random.Random(listed)
    rows = [(i, sorted(r.sample([f"w{k}" for k in range(40)], r.choice((0, 1, 2, 3, 5, 8, 9)))), r.random() < 0.2) for i in range(150)]
    near = lambda a, b: linking._alike(a, b) >= linking.DOUBT
    sets = {i: (frozenset(w), update) for i, w, update in rows}
    inside = lambda a, b: b[1] and len(a[0]) >= 2 and a[0] <= b[0]
    pairs = [(i, j) for i in sets for j in sets if i < j and (near(sets[i][0], sets[j][0]) or inside(sets[i], sets[j]) or inside(sets[j], sets[i]))]
    titles = spark.createDataFrame(rows, "id long, words array<string>, update boolean")
    edges = [(x.a, x.b) for x in linking.title_edges(titles).collect()]
    assert parts_of(edges, sets) == parts_of(pairs, sets) and len(set(parts_of(pairs, sets).values())) > 10


def test_small_groups_decided_together(spark, monkeypatch):
    """Groups that share a task give what each gives alone."""
    rows = [(i, f"s{i % 5}", "x", "ITA", [], None, title, i) for i, title in enumerate([t.replace("parola", f"p{k}x") for k in range(6) for t in near_copies(20, k)])]
    frame = spark.createDataFrame(rows, SCHEMA)
    together = sorted(linking.link_groups(frame).collect())
    monkeypatch.setattr(linking, "TOGETHER", 1)
    assert together == sorted(linking.link_groups(frame).collect()) and len(together) == 120
