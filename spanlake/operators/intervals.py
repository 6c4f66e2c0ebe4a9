"""Joins of points and intervals by aligned blocks of time.

The line is cut into blocks of ``2**bits``, each two of them make a block of the next level, and so on. An interval
is dealt to the fewest aligned blocks that hold it, at most two a level; levels end where the whole line is ``TOP``
blocks, so that an interval over everything is under a hundred rows and no block meets more than a part of a key's
points. A point asks the one block that it lies in at each level, and meets an interval in exactly one of them. So containment is
an equi-join on keys, level and block, whatever the lengths of the intervals are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 32


def _blocks(lo: str, hi: str) -> str:
    """The aligned blocks that make up ``lo`` to ``hi`` (without it), of levels 0 to ``_top``: an odd begin or end stands alone,
    the rest goes up."""
    level = f"struct(k, shiftright({lo} + shiftleft(1L, k) - 1L, k) as l, shiftright({hi}, k) as r)"
    odd = "concat(if(x.l % 2 <> 0, array(x.l), cast(array() as array<bigint>)), if(x.r % 2 <> 0, array(x.r - 1), cast(array() as array<bigint>)))"
    found = f"case when x.l >= x.r then cast(array() as array<bigint>) when x.k = _top then sequence(x.l, x.r - 1) else {odd} end"
    return f"flatten(transform(transform(sequence(0, _top), k -> {level}), x -> transform({found}, b -> struct(x.k as k, b as b))))"


def contained(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, bucket_ns: int, tasks: int | None = None) -> DataFrame:
    """``points`` with the intervals of equal ``keys`` that hold them, both ends included.

    The sides share no column but the keys; an interval with a null end, or one that ends before it starts, holds nothing.
    ``bucket_ns`` sets the finest block, the greatest power of two that is not above it, and changes no result.
    ``tasks`` deals the pairs to so many, where more come out than go in.
    """
    bits = max(0, int(bucket_ns).bit_length() - 1)
    span = intervals.agg(F.shiftright(F.min(start), bits).alias("lo"), F.shiftright(F.max(end), bits).alias("hi"))
    top = F.greatest(F.length(F.bin(F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(1).cast("long")))) - TOP.bit_length(), F.lit(0))
    span = F.broadcast(span.select(F.coalesce(top, F.lit(0)).cast("int").alias("_top")))  # one row
    dealt = intervals.where(F.col(end).isNotNull()).join(span)
    dealt = dealt.withColumns({"_lo": F.shiftright(start, bits), "_hi": F.shiftright(end, bits) + 1}).withColumn("_b", F.explode(F.expr(_blocks("_lo", "_hi")))).drop("_lo", "_hi", "_top")
    asks = points.join(span).withColumn("_p", F.shiftright(at, bits)).withColumn("_b", F.explode(F.expr("transform(sequence(0, _top), k -> struct(k as k, shiftright(_p, k) as b))"))).drop("_p", "_top")
    if tasks:
        asks, dealt = (x.repartition(tasks, *keys, "_b") for x in (asks, dealt))
    return asks.join(dealt, [*keys, "_b"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_b")
