import random

import pytest

WORDS = ("the of and to in is river stone cloud lamp paper glass north wind table seven green quiet engine window harbor "
         "silver yellow mountain candle bridge forest copper violin saddle marble lantern").split()  # fmt: skip
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, per_line: int = 14) -> str:
    rng = random.Random(seed)
    made = [rng.choice(WORDS) + (rng.choice(("", "er", "ing", "s", "ly", str(rng.randint(0, 40)))) if rng.random() < 0.7 else "") for _ in range(n)]
    return "\n".join(" ".join(made[i : i + per_line]) + "." for i in range(0, n, per_line))


@pytest.fixture(scope="session")
def make(spark):
    def of(texts, langs=None):
        rows = [(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return of


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names the operators use."""
    rows = [
        (0, "", "en", "a", 0, 1), (1, None, None, None, None, None), (2, prose(2, 60), "en", "a", 1, 2), (2, prose(2, 60), "en", "a", 1, 2),
        (None, prose(3, 60), "en", "a", 1, 3), (4, "word", "en", "a", 4, 4), (5, " \n\t ", "en", "a", 4, 4), (6, prose(6, 30_000), "en", "a", 4, 4),
        (7, "x" * 200_000, "en", "a", 4, 4), (8, prose(2, 60), "en", "b", 1, 9), (9, "Ünï ﬁ 日本 ½ <|endoftext|> It's", "fr", "b", 1, 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", id long")
    return df.selectExpr("*", "1 as score", "'k' as key", "2 as length", "'z' as root", "'q' as token", "0 as rank", "5 as removed", "3 as line", "7 as b")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
