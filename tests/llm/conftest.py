import random

import pytest

#: Extra columns whose names clash with what the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, fp string, n int, is_heavy string"


def odd_rows():
    """Nulls, blanks, ties, repeated rows, copies, a hot source, a long text."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "eps", "zeta", "été", "naïve", "x1", "Омега", "the", "of", "and"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 160)), "en", f"s{i % 4}" if i % 3 else "hot") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \t\n ", "en", None), (None, "no id at all", "en", "s2")]
    rows += [(None, "no id at all", "en", "s2"), (None, None, None, None)]
    rows += [(200 + i, "same  text\nhere", "en", "hot") for i in range(30)] + [(199, "same text here", "en", "s1")]
    rows += [(300, "repeated row", "en", "s3")] * 3 + [(301, "repeated row", "en", "s3")]
    rows += [(400, text(30_000), "en", "hot"), (401, "w", "en", "s0"), (402, "x" * 50_000, "en", "s0")]
    rows += [(403, "<|endoftext|> it's 'll and\u00a0nbsp \u2003 wide", "en", "s0")]
    return [(d, t, l, s, len(t or ""), "k", 7, "f", 1, "h") for d, t, l, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
