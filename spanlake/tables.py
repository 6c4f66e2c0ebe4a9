"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import on_workers

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where it is unset and all of Spark is one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that no later stage recomputes it.

    Nothing reads the shuffle files of such a write again; Spark is told to drop them at its end.
    """
    spark = df.sparkSession
    on_workers(spark)
    path = new_path(spark, label)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def exact_longs(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``df``, a few rows of totals in decimals, with ``columns`` as longs where all their values fit, else as decimal(38,0)."""
    d = materialize(df, label)
    fit = [F.bool_and(F.col(c).isNull() | F.col(c).try_cast("long").isNotNull()).alias(c) for c in columns]
    fits = d.agg(*fit).first()  # one row
    return d.withColumns({c: F.col(c).cast("decimal(38,0)" if fits[c] is False else "long") for c in columns})
