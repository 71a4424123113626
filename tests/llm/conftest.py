import random

import pytest

SCHEMA = "doc_id long, text string"


def made_texts(seed=1, n=120):
    """Texts with exact copies, near copies, shared passages, odd characters, nulls and empties."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgéß漢Ab", k=rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(n):
        kind = i % 12
        if kind == 0 and i:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 1 and i > 12:
            base = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            base[rng.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind == 2:
            text = " ".join(rng.choices(words, k=30)) + "\n" + passage + "\t" + " ".join(rng.choices(words, k=30))
        else:
            text = " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 20, 80, 200])))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n\x0b\x0c\r"), (n + 3, rows[5][1] + "  "), (n + 4, "x"), (n + 5, "x")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, one very long text, and columns whose names clash with inner ones."""
    long = "lorem ipsum dolor sit amet consectetur " * 8000
    rows = [(None, "a b c", "x"), (None, "a b c", "y"), (1, "q w e r t y", "z"), (1, "q w e r t y", "z"), (2, long, "l"), (3, None, "n"), (4, "", "e"), (5, "q w e r t z", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    return frame.selectExpr("doc_id", "text", "digest", "digest AS row", "1 AS keep_id", "2L AS n_chars", "3 AS n", "4 AS h", "'s' AS spots", "'k' AS `key`", "'v' AS bands")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 3 > 0, i % 10 == 0) for i, _ in rows], "doc_id long, q boolean, t boolean").selectExpr("doc_id", "int(q) AS quality", "int(t) AS toxic")
