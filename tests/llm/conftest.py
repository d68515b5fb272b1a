import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, cls string, length string"

LONG = "abc " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    texts = [None, "", " \t\n", "word", "word ", "w ord", LONG, LONG, "a b c d e f", "A b C d e f", "tie one", "tie two", "é中𝄞 <|endoftext|>", "x" * 3000]
    rows = [(i, t, "en" if i % 2 else None, None, None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(3, "word", "en", "s", 4, None, None, None), (None, "word", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def folder(tmp_path):
    """folder(documents=df, ...) writes tables and returns where."""

    def write(**tables):
        for name, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
