import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
PASSAGE = " ".join(f"alpha{i}" for i in range(40))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    from pyspark.sql import functions as F
    rows = [(None, "a null id and some words"), (1, None), (2, ""), (3, " \t\n"), (4, "single"),
            (5, f"{PASSAGE}\nsecond line here\nthird line"), (6, f"before it {PASSAGE} after it"),
            (6, f"before it {PASSAGE} after it"), (7, f"{PASSAGE}\nsecond line here\nthird line"),
            (7, "another text of the same id"), (8, LONG), (9, LONG + " tail"), (10, "naïve café\u00a0x \u2028 日本語 \U0001f600"),
            (11, "a\r\nb\r\n\r\nc  d   e\t\tf \n g"), (None, "a null id and some words"), (-3, PASSAGE), (12, "12 34 !! ??"),
            (13, "<|endoftext|> it's we'll  I'D ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "raw", "key", "n_words", "fp", "ids", "kept", "score", "lang", "id", "tie", "host"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
