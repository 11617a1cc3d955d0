import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: A column of every name that operators use inside, to clash with them.
CLASHING = ("id", "th", "doc", "t", "w", "k", "c", "h", "size", "copies", "fp", "gone", "component", "draw", "target", "spots", "spans", "kept", "one", "r", "lines", "copy_no2")


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, one id with two texts, a long text, clashing columns."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", None, 4), (3, "one two three", None, "a", 13), (3, "one two three", None, "a", 13), (3, "another text for the same id", "en", "b", 5), (None, "no id here", "en", "b", 3), (4, "word " * 30_000, "en", "b", 1), (5, "Ünïcode ßtraße 日本 😀", "de", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.selectExpr("*", f"1 as {name}")
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
