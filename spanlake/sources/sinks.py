"""Exports and summaries. Each export has a form that returns its lines as a DataFrame and one that writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import fmt_time
from ..operators.scopes import KEYS, depths


def ctf_lines(df: DataFrame, logs: DataFrame | None = None, threads: DataFrame | None = None, waits: DataFrame | None = None, streams: DataFrame | None = None) -> DataFrame:
    """Chrome trace events as JSON lines ``(part, date_ns, seq, line)``: B and E of scopes and of lock waits (as
    ``locks.lock_waits`` gives them; B alone where they never end), instants of logs, names of threads, and of processes from ``streams(stream_id, name)``."""
    d = depths(df).where("kind in ('scope_begin', 'scope_end') and not orphan")
    js = lambda *c: F.to_json(F.struct(*c))
    common = [F.col("stream_id").alias("pid"), F.col("thread_id").alias("tid")]
    ts = (F.col("date_ns") / 1000).alias("ts")
    ph = F.when(F.col("kind") == "scope_begin", "B").otherwise("E").alias("ph")
    out = d.select(F.lit(1).alias("part"), "date_ns", "seq", js(F.col("name"), F.lit("Scope").alias("cat"), ph, ts, *common).alias("line"))
    if logs is not None:
        out = out.unionByName(logs.select(F.lit(1).alias("part"), "date_ns", "seq", js(F.col("message").alias("name"), F.col("category").alias("cat"), F.lit("i").alias("ph"), ts, *common).alias("line")))
    if waits is not None:
        ends = F.explode(F.array(*[F.struct(F.lit(x).alias("ph"), F.col(c).alias("date_ns")) for x, c in (("B", "start_ns"), ("E", "end_ns"))]))
        w = waits.select(*KEYS, "name", "seq", ends.alias("_at")).select("*", "_at.ph", "_at.date_ns").where("date_ns is not null")
        out = out.unionByName(w.select(F.lit(1).alias("part"), "date_ns", "seq", js(F.col("name"), F.lit("Lock wait").alias("cat"), F.col("ph"), ts, *common).alias("line")))
    if threads is not None:
        meta = js(F.lit("thread_name").alias("name"), F.lit("M").alias("ph"), *common, F.struct("name").alias("args"))
        out = out.unionByName(threads.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("date_ns"), F.lit(0).cast("long").alias("seq"), meta.alias("line")))
    if streams is not None:
        meta = js(F.lit("process_name").alias("name"), F.lit("M").alias("ph"), F.col("stream_id").alias("pid"), F.struct("name").alias("args"))
        out = out.unionByName(streams.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("date_ns"), F.lit(0).cast("long").alias("seq"), meta.alias("line")))
    return out


def export_ctf(df: DataFrame, path: str, **more) -> None:
    ctf_lines(df, **more).orderBy("part", "date_ns", "seq").select("line").write.text(path)


def text_lines(df: DataFrame, rng: tuple[int, int] | None = None) -> DataFrame:
    """``(stream_id, thread_id, date_ns, seq, line)``: a trace as indented text, two spaces a level."""
    d = depths(df).where("not orphan and kind <> 'scope_end'")
    d = d if rng is None else d.where(F.col("date_ns").between(*rng))
    line = F.concat(fmt_time(F.col("date_ns")), F.lit(" "), F.repeat(F.lit("  "), F.col("level").cast("int")), F.col("name"), F.coalesce(F.concat(F.lit(" = "), F.col("v_double").cast("string")), F.lit("")))
    return d.select(*KEYS, "date_ns", "seq", line.alias("line"))


def export_text(df: DataFrame, path: str, rng: tuple[int, int] | None = None, n: int | None = None) -> None:
    out = text_lines(df, rng).orderBy(*KEYS, "date_ns", "seq")
    (out if n is None else out.limit(n)).select("line").write.text(path)


def log_lines(logs: DataFrame, rng: tuple[int, int] | None = None) -> DataFrame:
    """``(date_ns, seq, line)``: time, level, thread and category padded to the widest, message."""
    d = logs if rng is None else logs.where(F.col("date_ns").between(*rng))
    level = F.element_at(F.array(*[F.lit(x) for x in ("debug", "info ", "warn ", "error")]), F.col("log_level") + 1)
    d = d.withColumn("_t", F.concat(F.lit("Thread "), F.col("thread_id").cast("string")))
    wide = d.agg(F.max(F.length("_t")).alias("_wt"), F.max(F.length("category")).alias("_wc"))  # one row
    d = d.join(F.broadcast(wide))
    line = F.concat_ws(" ", fmt_time(F.col("date_ns")), F.concat(F.lit("["), level, F.lit("]")), F.rpad("_t", F.col("_wt"), F.lit(" ")), F.rpad("category", F.col("_wc"), F.lit(" ")), F.col("message"))
    return d.select("date_ns", "seq", line.alias("line"))


def export_logs(logs: DataFrame, path: str, rng: tuple[int, int] | None = None) -> None:
    log_lines(logs, rng).orderBy("date_ns", "seq").select("line").write.text(path)


def series_lines(s: DataFrame, rng: tuple[int, int] | None = None) -> DataFrame:
    """``time,value`` by kind of series: the notifying thread, the thread and held time of a lock, else the value, with nine
    decimals if it is not whole (empty if null)."""
    d = s if rng is None else s.where(F.col("time_ns").between(*rng))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("decimal(38,9)").cast("string"))
    last = F.when(F.col("kind") == "notify", F.col("thread_id").cast("string")).when(F.col("kind") == "lock_use", F.concat_ws(",", F.col("thread_id").cast("string"), F.col("value").cast("long").cast("string"))).otherwise(F.coalesce(number, F.lit("")))
    return d.select("kind", "path", "time_ns", "seq", F.concat_ws(",", F.col("time_ns").cast("string"), last).alias("line"))


def export_series(s: DataFrame, path: str, rng: tuple[int, int] | None = None) -> None:
    d = s if rng is None else s.where(F.col("time_ns").between(*rng))
    d.orderBy("kind", "path", "time_ns", "seq").write.option("header", True).csv(path)


def trace_summary(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Event counts by family and thread with subtotals, and the share of all events; with ``stored_size`` of the trace its
    ``bytes``, and ``share_bytes`` by that share."""
    family = F.when(F.col("kind").startswith("scope"), "scope").when(F.col("kind").startswith("lock"), "lock").otherwise(F.col("kind"))
    d = df.select(family.alias("family"), "thread_id", "date_ns")
    g = d.rollup("family", "thread_id").agg(F.count("*").alias("n"), F.min("date_ns").alias("first_ns"), F.max("date_ns").alias("last_ns"), F.grouping_id().alias("level"))
    total = df.agg(F.count("*").alias("_all"))  # one row
    g = g.join(F.broadcast(total))
    size = []
    if stored is not None:
        g = g.join(F.broadcast(stored.select("bytes")))  # one row
        size = ["bytes", F.floor(F.col("bytes") * F.col("n") / F.col("_all")).cast("long").alias("share_bytes")]
    return g.select("family", "thread_id", "level", "n", *size, F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("pct"), (F.col("last_ns") - F.col("first_ns")).alias("span_ns"))


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """``(files, bytes)`` of a stored trace, as its scan knows them."""
    files = spark.read.parquet(f"{path}/events").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def run_catalog(runs: DataFrame) -> DataFrame:
    """Runs ``(app, run_id, date, size, nickname)`` newest first in their app, apps with their latest run and total size."""
    w = Window.partitionBy("app").orderBy(F.desc("date"), F.desc("run_id"))
    apps = runs.groupBy("app").agg(F.max("date").alias("latest"), F.sum("size").alias("app_size"), F.count("*").alias("app_runs"))
    return runs.withColumn("rank", F.row_number().over(w)).join(apps, "app")


def retention(runs: DataFrame, keep: int) -> DataFrame:
    """Runs beyond the newest ``keep`` of their app that have no nickname; nothing is deleted."""
    w = Window.partitionBy("app").orderBy(F.desc("date"), F.desc("run_id"))
    return runs.where("nickname is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") > keep)
