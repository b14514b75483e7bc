import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
PROSE = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, PROSE), (2, PROSE), (2, PROSE), (None, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, LONG), (8, LONG + " tail"),
        (9, PROSE.replace("word60", "other")), (10, "Ünï çödé ß İ   \x00 <|endoftext|> 漢字"), (None, None), (11, "x" * 5_000), (12, "x" * 5_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for clash in ("row_id", "__row", "kept", "score", "chunk", "part", "learn", "length", "ids", "lang"):
        df = df.withColumn(clash, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
