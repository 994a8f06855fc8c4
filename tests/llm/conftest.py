import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # columns whose names clash with those the operators make
                     T.StructField("score", T.StringType()), T.StructField("n_removed", T.StringType()),
                     T.StructField("epoch", T.StringType()), T.StructField("id", T.StringType()), T.StructField("bin", T.StringType())])
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns are filled in."""
    full = [(i, t, la, s, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t, la, s in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
AWKWARD = [(1, None, "en", "src0"), (2, "", None, None), (None, "null id here", "en", "src1"), (3, "   \n\t\n ", "de", "src0"),
           (4, LONG, "en", "src0"), (5, "same text twice", "en", "src2"), (5, "same text twice", "en", "src2"),
           (6, "SAME text twice", "fr", "src2"), (7, "123 !!! ???", None, "src3"), (8, "퟿ é ß 漢字\nline two", "de", None)]


@pytest.fixture
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.fixture
def empty(spark):
    return table(spark, [])


@pytest.fixture
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


__all__ = ["AWKWARD", "F", "LONG", "SF", "rows", "table"]
