import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def shared(spark):
    """Everything here needs the shared folder, which the tests' session names."""
    assert spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return spark


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows and ids, and
    columns whose names the operators use themselves."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, passage, "en", "a", 1), (2, passage, "en", "a", 1), (2, passage, "en", "a", 1),
        (3, "lead in " + passage + " and out", None, "b", None), (4, None, "en", "b", 0), (5, "", None, None, 0),
        (6, " \t\n ", "en", "c", 3), (7, "a b", "en", None, 3), (8, "A  b", "en", "c", 4), (9, "a\nb", "en", "c", 3),
        (10, "one two three four five six " * 400, "en", "c", 0), (11, "x" * 300, "en", "d", 0),
        (12, "x" * 49, "en", "d", 0), (None, passage, "en", None, 0), (None, "alone with no id", None, "d", 0),
        (13, passage.upper(), "en", "d", 0), (14, passage.replace("word30", "changed"), "en", "d", 0),
        (15, "# | % $ & * < > !! " * 20, "de", "é", 0), (16, "日本語 text naïve ½ it's", "ja", "日", 0),
        (17, passage + " " + passage, "en", "a", 0), (18, "y " * 20000, "en", "a", 0),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({
        "size": F.lit("clash"), "kept": F.lit(1), "key": F.lit(0), "part": F.lit("p"), "rep": F.lit(None).cast("string"),
        "place": F.lit(1.5), "digest": F.lit("d"), "fingerprint": F.lit(7), "score": F.lit("s")}).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
