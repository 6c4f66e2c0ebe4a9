"""CPU: core intervals, usage curve, thread run intervals, soft interrupts.

Context switches are ``(stream_id, seq, date_ns, core, runner)``; a runner is a thread id, -1 idle, -2 another process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import CHUNK, Scan, running

CORE = ["stream_id", "core"]


def _latest(df: DataFrame) -> DataFrame:
    """Of switches of one core at one date, the last arrived."""
    return df.groupBy(*CORE, "date_ns").agg(F.max_by("runner", "seq").alias("runner"), F.max("seq").alias("seq"))


def core_intervals(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(stream_id, core, runner, start_ns, end_ns, duration_ns)``; the last interval of a core is open."""
    s = Scan(_latest(df), CORE, ("date_ns",), chunk)
    d = s.run({"_was": ("last", F.col("runner"), "before")})
    change = F.when(F.col("_was").isNull() | (F.col("_was") != F.col("runner")), F.col("date_ns"))
    d = s.done(s.run({"end_ns": ("last", change, "before back")}, d)).where(change.isNotNull())
    return d.select(*CORE, "runner", F.col("date_ns").alias("start_ns"), "end_ns", (F.col("end_ns") - F.col("date_ns")).alias("duration_ns"))


def cpu_curve(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(stream_id, date_ns, cores_used, ratio)`` at every date where the number of cores in use by the program changes."""
    used = F.when(F.col("runner") >= 0, 1).otherwise(0)
    d = running(_latest(df).withColumn("_u", used), CORE, {"_was": ("last", F.col("_u"), "before")}, chunk, ("date_ns",))
    steps = d.groupBy("stream_id", "date_ns").agg(F.sum(F.col("_u") - F.coalesce("_was", F.lit(0))).alias("_d")).where("_d <> 0")
    cores = df.groupBy("stream_id").agg(F.count_distinct("core").alias("_cores"))
    out = running(steps, ["stream_id"], {"cores_used": ("sum", F.col("_d"))}, chunk, ("date_ns",)).join(cores, "stream_id")
    return out.select("stream_id", "date_ns", "cores_used", F.round(F.col("cores_used") / F.col("_cores"), 6).alias("ratio"))


def thread_run_intervals(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(stream_id, thread_id, core, start_ns, end_ns, off_ns)``: each run of a thread, and the time until its next."""
    runs = core_intervals(df, chunk).where("runner >= 0").withColumnRenamed("runner", "thread_id")
    d = running(runs, ["stream_id", "thread_id"], {"_next": ("last", F.col("start_ns"), "before back")}, chunk, ("start_ns", "core"))
    return d.select("stream_id", "thread_id", "core", "start_ns", "end_ns", (F.col("_next") - F.col("end_ns")).alias("off_ns"))


def softirq_intervals(df: DataFrame) -> DataFrame:
    """``(stream_id, thread_id, name, start_ns, end_ns, is_open)`` from softirq_begin and softirq_end rows."""
    w = Window.partitionBy("stream_id", "thread_id").orderBy("date_ns", "seq")
    d = df.where(F.col("kind").isin("softirq_begin", "softirq_end")).select(
        "*", F.lead("kind").over(w).alias("_k"), F.lead("date_ns").over(w).alias("_e")
    )
    last = df.groupBy("stream_id").agg(F.max("date_ns").alias("_last"))
    d = d.where("kind = 'softirq_begin'").join(last, "stream_id")
    closed = F.col("_k").isNotNull()
    return d.select("stream_id", "thread_id", "name", F.col("date_ns").alias("start_ns"), F.when(closed, F.col("_e")).otherwise(F.col("_last")).alias("end_ns"), (~closed).alias("is_open"))


def core_utilisation(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy(*CORE, "runner").agg(F.coalesce(F.sum("duration_ns"), F.lit(0)).alias("busy_ns"), F.count("*").alias("runs"))
