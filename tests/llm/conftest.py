import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, documents):
    """Documents with nulls, empty and long texts, repeated rows, repeated ids, and columns whose names clash with the operators' own."""
    long_text = " ".join(f"word{i % 977} für {i}" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (None, "the same text of five words or more here", "en", "s", 1), (900_001, None, "en", None, 0), (900_002, "", None, "s", 0), (900_003, " \n\t ", "en", "s", 4),
        (900_004, long_text, "en", "s", len(long_text)), (900_005, "one two", "en", "s", 7), (900_005, "one two", "en", "s", 7), (900_006, "ONE two", "en", "s", 7), (900_007, "日本語 é́ x\x1cy don't 🙂​", "de", "t", 9),
        (900_008, "a b c a b c " * 40, "en", "s", 480),
    ]
    extra = spark.createDataFrame(rows, documents.schema)
    clash = {c: F.lit(7) for c in ("n_words", "score", "rate", "copies", "kept", "id", "fp", "ids", "posterior", "n_tokens", "key", "_score")}
    return documents.limit(40).unionByName(extra).withColumns(clash)


@pytest.fixture(scope="session")
def none(documents):
    return documents.where("false")
