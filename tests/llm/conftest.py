"""Fixtures for the training-data operators."""
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, sources=None, extra=()):
    """documents rows with ids 0.. ; ``extra`` adds columns with clashing names."""
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), None if t is None else len(t))
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for c in extra:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, blank, very long, repeated and null-id rows; clashing extra columns."""
    long = "alpha beta gamma delta " * 20_000
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4),
            (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "one", "en", None, 3),
            (None, "one", "en", "s", 3), (5, "one two\none two\none two\n", "de", "s", 24)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    names = ("fp key part u v node root first n a ids row_key line score label toxic host total q k g j "
             "lo hi at window start length pos block weight page_id item_id").split()
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def real_docs(sf):
    return duckdb.sql(f"SELECT * FROM '{sf}/documents.parquet'").df()
