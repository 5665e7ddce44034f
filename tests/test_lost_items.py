"""Lost items against every pair scored in plain Python."""

import difflib
import random

from noticeworks.operators import cards


def test_bounds_lose_nothing(spark):
    rng = random.Random(3)
    some = ["comune", *("".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(3, 9))) for _ in range(40))]
    title = lambda: " ".join(["comune", *(rng.choice(some) for _ in range(rng.randrange(7)))])
    titles = [title() for _ in range(300)] + ["", None, "di del", "comune"]
    lost = [(i, None, rng.choice([t or "", title()])) for i, t in enumerate(titles[:80])] + [(900, None, None), (901, None, "")]
    others = [(i, None, t) for i, t in enumerate(titles)]
    plain = lambda t: [w for w in (t or "").split() if w not in cards.TITLE_STOP]

    def best(t):
        pairs = [(difflib.SequenceMatcher(None, " ".join(plain(t)), " ".join(plain(o))).ratio(), -i) for i, _, o in others if set(plain(t)) & set(plain(o))]
        score, i = max(pairs, default=(0.0, 0))
        return (-i, "title", round(score, 4)) if score >= 0.72 else (None, None, None)

    schema = "id long, url string, title string"
    out = cards.found_elsewhere(spark.createDataFrame(lost, schema), spark.createDataFrame(others, schema))
    want = {i: best(t) for i, _, t in lost}
    assert 20 < sum(w[0] is not None for w in want.values())
    assert {r.id: (r.found, r.how, r.score) for r in out.collect()} == want
