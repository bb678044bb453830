import pytest

COPIED = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bend at night"
HEAD = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, source=None):
    return [(i, t, "en", (source or (lambda i: f"s{i % 3}"))(i), len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and a column with a clashing name."""
    long = " ".join(f"w{i}" for i in range(6_000))
    texts = [None, "", " \n\t", "one", COPIED, COPIED.upper(), long, "café ☕ naïve\n\n日本語の文章です", "a\nb\na\nb", None]
    rows = rows_of(texts, lambda i: None if i == 3 else f"s{i % 2}")
    return spark.createDataFrame([*rows, rows[4]], HEAD).selectExpr("*", "1 AS score", "2 AS shard", "'x' AS n_lines")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], HEAD)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
