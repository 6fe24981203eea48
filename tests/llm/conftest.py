import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Small documents with nulls, blanks, copies, near copies, shared passages and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, base = prose(25), prose(120)
    texts = [None, "", " \t\n", "one", "a b c d", "Ab ab AB\nab\n\nAb ab AB", prose(20000)]
    while len(texts) < n:
        kind = rng.randrange(6)
        words = base.split()
        if kind == 0:
            words[rng.randrange(120)] = "edited"
            texts.append(" ".join(words))
        elif kind == 1:
            texts.append(base)
        elif kind == 2:
            texts.append(prose(30) + "\n" + passage + "\n" + prose(12))
        elif kind == 3:
            texts.append("Common Line here\n" + prose(40) + "\n" + " ".join(["so"] * rng.randrange(1, 30)))
        else:
            texts.append(prose(rng.randrange(1, 60)))
    return [(i * 3 % 101, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, an extra column and ones whose names the operators use inside."""
    rows = [(None, "x y z " * 20, "en", "s", 1), (None, None, None, None, None), (5, "p q r s t u v w x y z a b c d", "en", "s", 1), (5, "p q r s t u v w x y z a b c d", "en", "s", 1), (5, "other text", "en", None, 1), (6, "p q r s t u v w x y z a b c d", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as host", "2 as size", "3 as spans", "'k' as anchor", "4 as words", "5 as n", "6 as component", "7 as target")
