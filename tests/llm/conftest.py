import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, a null id, and columns with clashing names."""
    rows = [
        (1, "The same line is here, long enough\nand another one", "en", "src0", 10), (2, "the same line is here, LONG enough \nother", "en", "src0", 10),
        (3, "\tThe same line is here, long enough", "en", None, None), (3, "\tThe same line is here, long enough", "en", None, None),
        (4, None, None, None, None), (5, "", "de", "src1", 0), (6, " \t\n ", None, "src1", 4), (7, LONG, "en", "src0", len(LONG)), (8, LONG.upper(), "en", "src0", len(LONG)),
        (None, "The same line is here, long enough", "en", "src0", 1), (9, "1234 5678 !!", "fr", "src2", 12), (9, "ein anderer Text unter einer alten Nummer", "de", "src2", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 AS fp", "'x' AS line", "2 AS n", "'y' AS digest", "3 AS pos", "4 AS o", "5 AS r", "true AS kept", "'z' AS term", "0 AS low", "'p' AS path", "7 AS h1", "0D AS score", "'q' AS norm")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
