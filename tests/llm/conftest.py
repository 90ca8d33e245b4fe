import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns whose names the operators use themselves.
CLASHES = ["id", "print", "tokens", "copies", "domain", "anchor", "root", "_cuts", "_cut_id", "cut_text", "_mix_copies", "mix_copy", "_gone_id", "found", "value", "key", "bits"]


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with every kind of odd value: NULLs, empty, very long, ties, repeats."""
    rng = random.Random(4)
    base = sentence(rng, 60)
    long = sentence(rng, 60_000)
    rows = [(i, sentence(rng, 20 + i), "en" if i % 2 else "de", f"site{i % 3}") for i in range(12)]
    rows += [(20, base, "en", "site1"), (21, base, "en", "site1"), (21, base, "en", "site1"), (None, base, "en", None), (None, None, None, None)]
    rows += [(30, None, "fr", "site2"), (31, "", "fr", "site2"), (32, " \n\t ", None, ""), (33, "?!", "fr", "x"), (34, long, "en", "site1"), (35, long + " tail", "en", "site1"), (36, "你好 \U0001f600 ünïcödé", "fr", None), (20, "another text under the same identifier", "en", "site1")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).cache()


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
