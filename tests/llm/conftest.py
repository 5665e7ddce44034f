import random

import pytest

WORDS = [a + b for a in ("th", "er", "on", "an", "re", "ti", "wh", "st") for b in ("ea", "ing", "ou", "ble", "nd", "ly", "or")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return " ".join(words)


def corpus() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, a null id, copies, near copies, a shared passage, one long text, special characters."""
    passage = prose(99, 60)
    rows: list[tuple[int | None, str | None]] = [(i, prose(i, 40 + 10 * i)) for i in range(1, 9)]
    rows += [(20, None), (21, ""), (22, "one"), (23, "two words"), (24, "  \n "), (25, "日本語 🙂 naïve café x\r\n<|endoftext|> it's")]
    rows += [(30 + i, prose(3, 70)) for i in range(4)]
    rows += [(40 + i, edited(prose(50, 200), i, 2)) for i in range(6)]
    rows += [(60 + i, f"{prose(60 + i, 30)} {passage} {prose(70 + i, 30)}") for i in range(4)]
    rows += [(80, "a" * 3000), (81, "b" + "a" * 200), (90, prose(90, 6000)), (None, prose(5, 90)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3, "text").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
