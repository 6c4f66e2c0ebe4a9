"""Neighbours in a global order without one global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def with_next(keys: DataFrame, cols: list[str], wrap: bool, label: str = "order") -> DataFrame:
    """Distinct rows of ``keys[cols]`` with the next larger one in columns ``next_<col>``.

    The rows are dealt to ranges, ordered inside each range, and the ends of ranges are tied by a table of one row
    a range. After the last row comes null, or the first row if ``wrap``. ``cols`` hold no nulls.
    """
    key = F.struct(*cols)
    dealt = keys.select(*cols).distinct().repartitionByRange(*cols).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, label)
    inside = Window.partitionBy("range").orderBy(*cols)
    firsts = dealt.groupBy("range").agg(F.min(key).alias("first"))
    by_range = Window.orderBy("range")  # a row a range
    ties = firsts.select(
        "range",
        F.coalesce(
            F.lead("first").over(by_range),
            F.min("first").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if wrap else F.lit(None),
        ).alias("after"),
    )
    nxt = dealt.withColumn("next", F.lead(key).over(inside)).join(ties, "range").withColumn("next", F.coalesce("next", "after"))
    return nxt.select(*cols, *[F.col("next")[c].alias(f"next_{c}") for c in cols])
