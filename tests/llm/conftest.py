import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").cache()


@pytest.fixture(scope="session")
def more_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Documents with everything that may go wrong, read from a table like any other."""
    rows = [
        (0, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \t\n ", None, "a", 4), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (None, "one", "en", "b", 3),
        (None, None, None, None, None), (4, "The same words as before, said again and again in one line.", "en", "b", 59), (5, "The same words as before, said again and again in one line.", "en", "b", 59),
        (6, "été çà et là, naïve façade \U0001f600 ‍日本語 テキスト", "fr", "b", 30), (7, "x" * 60_000, "en", "b", 60_000), (8, "lorem ipsum dolor " * 9_000, "en", "c", 162_000),
        (9, "12345 67890 !!! ???", "de", "c", 19), (10, "key=" + "a1" * 5_000, "en", "c", 10_004), (11, "a\x0bb\x0cc d e f g", "en", "c", 15),
    ]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    frame = spark.createDataFrame(rows, SCHEMA)
    for clash in ("row", "node", "kept", "score", "predicted", "margin", "_row", "block", "uid", "h", "y", "part", "_found", "n"):
        frame = frame.withColumn(clash, F.lit(clash))
    frame.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
