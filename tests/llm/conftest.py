import random

import pytest

WORDS = "the of and to in is that for with as by at from are this be or an it was on not have has had but".split()


@pytest.fixture(scope="session")
def prose():
    """A seeded writer of invented texts."""
    rng = random.Random(1)

    def write(n, vocabulary=400):
        return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return write


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, an empty, a blank and a very long text, repeated rows, and extra columns with names that operators use."""
    rows = [(1, None, None, "s", 0, "x"), (2, "", "en", None, 0, "x"), (3, " \n\t ", "en", "s", 3, "x"), (4, "one two", "en", "s", None, None), (4, "one two", "en", "s", None, None), (None, "one two three four five six seven", "en", "s", 5, "x"), (5, "ab " * 60_000, "en", "s", 180_000, "x"), (6, "x" * 50_000, "fr", "s", 50_000, "x"), (7, "çà et là\u0085 naïve　😀 <|endoftext|>", "fr", "s", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    return df.selectExpr("*", "'z' AS label", "'z' AS host", "'z' AS a", "'z' AS hash", "'z' AS `print`", "'z' AS path2", "'z' AS keep")
