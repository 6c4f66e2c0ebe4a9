"""Numbers by a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in the order of ``order``, which tells the rows apart.

    The rows are dealt to ranges and counted inside each; what stands before a range comes from a table of a row a range.
    """
    d = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    inside = Window.partitionBy("_part").orderBy(*order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = d.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = d.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(bases), "_part")
    return out.select(*rows.columns, (F.col("_base") + F.col("_at")).cast("long").alias(name))
