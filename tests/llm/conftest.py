import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
# Columns of any table whose names the operators use for themselves.
CLASHES = ("fp", "length", "piece", "rank", "base", "row_hash", "text_hash", "key", "root", "part", "order")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def plain(n, seed=0):
    """A text of n words, the same for the same seed."""
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def rows(texts, langs=("en",), sources=("s",)):
    return [(k, t, langs[k % len(langs)], sources[k % len(sources)], len(t or ""), *["x"] * len(CLASHES))
            for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, langs=("en",), sources=("s",), more=()):
        data = rows(texts, langs, sources)
        return spark.createDataFrame([*data, *more], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, very long and non-Latin texts, ties, repeated rows, clashing column names."""
    long_text = plain(30000, 3) + " ÀÉ " + "z" * 5000
    texts = [None, "", " \n\t", plain(60), plain(60), long_text, "漢字 кириллица ٣ 😀 é", "a", "x\x1fy \x85z  q"]
    data = rows(texts, ("en", None), ("s", None))
    data += [data[3], data[3], (None, plain(70), None, None, None, *[None] * len(CLASHES)),
             (None, None, None, None, None, *[None] * len(CLASHES))]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
