"""Spark session helpers.

The library never creates its own session inside operators; these helpers
are for scripts, tests and the bench.  A cluster names a shared checkpoint
folder in ``spark.checkpoint.dir``; a scratch folder of our own is used only
in local mode (tests), and a session on a cluster without a shared folder is
refused.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "lendscope") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  In local mode a scratch folder is
    made when none is named; on a cluster a missing shared folder is an
    error, because a machine-local folder would lose rows there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="lendscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lendscope-scratch/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder
    and read it back: a lost executor recomputes nothing upstream of it.  The
    shuffle files of the write go with it, not when the driver's JVM happens to
    collect its garbage."""
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    for tables in _SCOPES:
        tables.append(made)
    return made


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def passing_tables():
    """Tables that ``materialize`` makes inside are deleted at the end, but
    those that the yielded function was given.  For work whose result is
    written inside."""
    tables, kept = [], []
    _SCOPES.append(tables)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        del _SCOPES[next(i for i, t in enumerate(_SCOPES) if t is tables)]
        discard(*[t for t in tables if not any(t is k for k in kept)])


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lendscope-scratch/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
