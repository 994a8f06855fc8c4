"""Loan-table scans and result sinks (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import encode_target, rename_columns


def load_loans(spark: SparkSession, paths, schema=None, fmt: str = "csv", mapping: dict | None = None,
               target: str = "target", good_value=None) -> DataFrame:
    """A1: scan CSV (header, explicit schema) or parquet, rename to English
    names, encode the target.  ``paths`` may be a list."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.option("header", "true").csv(paths) if fmt == "csv" else reader.parquet(*paths)
    if mapping:
        df = rename_columns(df, mapping)
    return encode_target(df, target, good_value) if target in df.columns else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A2: write a result table (CSV with header, or parquet)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def write_key_values(df: DataFrame, path: str, key: str = "metric", value: str = "value") -> None:
    """A3: headerless key,value CSV (one small file: the input has a handful
    of rows)."""
    df.select(F.col(key), F.col(value)).coalesce(1).write.mode("overwrite").option("header", "false").csv(path)
