"""Reading, merging and naming of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered

REQUIRED = {"stream_id", "thread_id", "seq", "date_ns", "kind", "name"}
VERSION = 1


def read_trace(spark: SparkSession, path: str, streams: list[int] | None = None, rng: tuple[int, int] | None = None) -> DataFrame:
    """A stored trace; filters on streams and dates reach the scan. A trace of another version is refused."""
    versions = {r.version for r in spark.read.parquet(f"{path}/meta").collect()}  # a row a trace
    if versions != {VERSION}:
        raise ValueError(f"a trace of version {sorted(versions)}; this reads version {VERSION}")
    df = spark.read.parquet(f"{path}/events")
    missing = REQUIRED - set(df.columns)
    if missing:
        raise ValueError(f"not a trace: columns {sorted(missing)} are missing")
    df = df.withColumn("stream_id", F.col("stream_id").cast("long"))
    if streams is not None:
        df = df.where(F.col("stream_id").isin(streams))
    return df if rng is None else df.where(F.col("date_ns").between(*rng))


def write_trace(df: DataFrame, path: str, day_ns: int = 86_400 * 10**9) -> None:
    """Partitioned by stream and day, sorted by date inside each file so that row groups can be skipped; a stream and day
    with most of the rows is spread over several files."""
    out = df.withColumn("day", F.floor(F.col("date_ns") / day_ns))
    order = ["stream_id", "day", "date_ns", "seq"]
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("stream_id", "day").parquet(f"{path}/events")
    df.sparkSession.range(1).select(F.lit(VERSION).alias("version")).coalesce(1).write.parquet(f"{path}/meta")


def import_streams(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Each file set becomes one stream, numbered in the order given."""
    out = None
    for i, p in enumerate(paths):
        d = spark.read.parquet(p).withColumn("stream_id", F.lit(i).cast("long"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def merge_streams(df: DataFrame, strings: DataFrame) -> DataFrame:
    """Events with globally unique ids: ``string_id`` by hash of the string (numbered by first appearance), and
    ``global_thread`` numbered by stream and thread. ``strings(stream_id, string_idx, hash, value)``."""
    ids = strings.groupBy("hash").agg(F.min(F.struct("stream_id", "string_idx")).alias("first"), F.min("value").alias("value"))
    ids = numbered(ids, ["first"], "string_id")
    known = strings.join(ids.select("hash", "string_id", F.col("value").alias("string")), "hash").select("stream_id", "string_idx", "string_id", "string")
    threads = df.select("stream_id", "thread_id").distinct()
    threads = numbered(threads, ["stream_id", "thread_id"], "global_thread")
    return df.join(known, ["stream_id", "string_idx"], "left").join(threads, ["stream_id", "thread_id"])


def unique_lock_names(df: DataFrame) -> DataFrame:
    """``df`` with ``lock``: the stream in which a name comes first keeps it, others get ``name#stream``."""
    first = df.groupBy("name").agg(F.min_by("stream_id", F.struct("seq", "stream_id")).alias("_first"))
    return df.join(first, "name").withColumn("lock", F.when(F.col("stream_id") == F.col("_first"), F.col("name")).otherwise(F.concat_ws("#", "name", F.col("stream_id").cast("string")))).drop("_first")


def name_threads(df: DataFrame, declared: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """``(stream_id, thread_id, group_name, name)``: the first declaration wins, default ``Thread N``, ``app: name`` with
    several streams, repeated names get ``#id``, the first ``/`` parts group and name.

    ``declared(stream_id, thread_id, seq, name)``; ``streams(stream_id, app)``.
    """
    k = ["stream_id", "thread_id"]
    first = declared.groupBy(*k).agg(F.min_by("name", "seq").alias("_name"))
    t = df.select(*k).distinct().join(first, k, "left")
    t = t.withColumn("_name", F.coalesce("_name", F.concat(F.lit("Thread "), F.col("thread_id").cast("string"))))
    if streams is not None:
        t = t.join(streams, "stream_id", "left").withColumn("_name", F.concat_ws(": ", "app", "_name"))
    w = Window.partitionBy("_name").orderBy(*k)
    t = t.withColumn("_n", F.row_number().over(w))
    full = F.when(F.col("_n") > 1, F.concat(F.col("_name"), F.lit("#"), F.col("thread_id").cast("string"))).otherwise(F.col("_name"))
    t = t.withColumn("_full", full)
    cut = F.instr("_full", "/")
    return t.select(*k, F.when(cut > 0, F.substring_index("_full", "/", 1)).otherwise("").alias("group_name"), F.when(cut > 0, F.expr("substring(_full, instr(_full, '/') + 1)")).otherwise(F.col("_full")).alias("name"))


def split_units(strings: DataFrame, column: str = "value") -> DataFrame:
    """``name##unit`` split and trimmed, with ``is_hexa`` and the number of lines."""
    parts = F.split(F.col(column), "##", 2)
    unit = F.trim(F.coalesce(F.get(parts, 1), F.lit("")))
    return strings.select("*", F.trim(F.get(parts, 0)).alias("base_name"), F.when(unit == "hexa", "").otherwise(unit).alias("unit"), (unit == "hexa").alias("is_hexa"), (F.regexp_count(F.col(column), F.lit("\n")) + 1).alias("n_lines"))


def split_corrupt(df: DataFrame, strings: DataFrame, column: str = "string_idx") -> tuple[DataFrame, DataFrame]:
    """Events of sound streams, and those of streams in which an event refers to an unknown string."""
    bad = df.where(F.col(column).isNotNull()).join(strings.select("stream_id", F.col("string_idx").alias(column)), ["stream_id", column], "left_anti").select("stream_id").distinct()
    return df.join(bad, "stream_id", "left_anti"), df.join(bad, "stream_id", "left_semi")


def catalog_threads(df: DataFrame) -> DataFrame:
    return df.groupBy("stream_id", "thread_id").agg(F.count("*").alias("events"), F.min("date_ns").alias("first_ns"), F.max("date_ns").alias("last_ns"))


def catalog_series(paths: DataFrame) -> DataFrame:
    """Known event kinds ``(path, kind, thread)``, by thread, kind and path without case."""
    return paths.select("stream_id", "thread_id", "kind", F.array_join("path", "/").alias("path")).distinct().orderBy("thread_id", F.lower("kind"), "path")
