import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, ...) rows."""
    def make(rows, schema=DOCS):
        full = [tuple(r) + (None,) * (len(schema) - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)
    return make


def passage(seed, n, vocabulary=4000):
    """``n`` made-up words."""
    import random
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows and keys, one long text, all kinds of white space."""
    long = " ".join(passage(1, 30_000))
    return [(1, "a b c", "en", "s1"), (1, "a b c", "en", "s1"), (1, "other words", "fr", None), (None, None, None, None), (None, "x y", None, "s2"),
            (2, "", "en", "s1"), (3, None, "en", "s1"), (4, " \n\t ", "de", "s3"), (5, long, "en", "s1"), (6, long, "en", "s2"),
            (7, "é́  x y\x1cz  \n  <|endoftext|> 12 🙂", "es", "s1"), (8, "the " * 60, "en", "s1"), (-3, "neg", "en", "s9")]
