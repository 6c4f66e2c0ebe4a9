"""Repair of clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import CHUNK, Scan, running

KEYS = ["stream_id", "thread_id"]


def unwrap_counter(df: DataFrame, column: str, bits: int = 32, keys: list[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``<column>_full``: a counter of few bits made whole; it wrapped where it falls by over a quarter."""
    slack = (1 << (bits - 2)) - 1
    s = Scan(df, keys, chunk=chunk)
    d = s.run({"_last": ("last", F.col(column), "before")})
    fell = F.when(F.col(column) < F.coalesce("_last", F.lit(0)) - slack, 1).otherwise(0)
    d = s.done(s.run({"_wraps": ("sum", fell)}, d))
    return d.withColumn(f"{column}_full", F.col(column) + F.lit(1 << bits) * F.col("_wraps")).drop("_last", "_wraps")


def resync_counter(df: DataFrame, references: DataFrame, column: str, bits: int = 32) -> DataFrame:
    """Whole dates by the reference of each buffer: ``references(stream_id, buffer_id, tick)`` holds a full tick; the
    counter is the value with these low bits that is nearest to it, from half a period before to half a period after."""
    j = df.join(references, ["stream_id", "buffer_id"])
    base = F.col("tick") - F.pmod(F.col("tick"), F.lit(1 << bits)) + F.col(column)
    half = 1 << (bits - 1)
    near = F.when(base < F.col("tick") - half, F.lit(1 << bits)).when(base >= F.col("tick") + half, F.lit(-(1 << bits))).otherwise(0)
    return j.withColumn(f"{column}_full", base + near)


def monotonic_dates(df: DataFrame, keys: list[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``fixed_ns``: each date if it is later than the fixed one before it, else that one plus 1."""
    s = Scan(df, keys, chunk=chunk)
    d = s.run({"_i": ("sum", F.lit(1).cast("long"))})
    d = s.done(s.run({"_up": ("max", F.col("date_ns") - F.col("_i"))}, d))
    return d.withColumn("fixed_ns", F.col("_i") + F.greatest(F.lit(0).cast("long"), F.col("_up"))).drop("_i", "_up")


def clamp_dates(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``fixed_ns``: dates never go back inside a stream, in arrival order."""
    return running(df, ["stream_id"], {"fixed_ns": ("max", F.col("date_ns"))}, chunk=chunk)


def ticks_to_ns(df: DataFrame, calibration: DataFrame, column: str = "tick") -> DataFrame:
    """``calibration(stream_id, origin, ns_per_tick)``; ticks before the origin become 0."""
    j = df.join(calibration, "stream_id")
    past = F.col(column) - F.col("origin")
    return j.withColumn("date_ns", F.when(past < 0, 0).otherwise(F.floor(past * F.col("ns_per_tick"))).cast("long")).drop("origin", "ns_per_tick")
