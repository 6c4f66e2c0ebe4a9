"""Running values over one key's rows, without a task for each key where a key is large.

A window over a thread, lock or stream is one task for each key. One aggregate tells whether any key has more than ``chunk``
rows. If none has, plain windows do. Else the rows are dealt to ranges of (keys, order) of about ``chunk`` rows, which cut
large keys and leave small ones whole; totals of a key in each range are scanned in a table of about as many rows as
there are keys and ranges and joined back, and windows run inside ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

CHUNK = 1 << 20
MOST_RANGES = 1 << 16
_OVER = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
Value = tuple[str, Column] | tuple[str, Column, str]


class Scan:
    """``df`` in the order of ``order`` inside ``keys``. Keys are not null, and ``order`` tells the rows of a key apart.

    ``rows`` are its rows, to which columns may be added between runs; ``done`` drops what the scan has added.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: tuple[str, ...] = ("seq",), chunk: int = CHUNK):
        self.keys, self.order = keys, order
        n = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        self.hot = (n.most or 0) > chunk
        self.rows = df
        if self.hot:
            ranges = min(MOST_RANGES, -(-n.all // chunk))
            self.rows = materialize(df.repartitionByRange(ranges, *keys, *order).withColumn("_chunk", F.spark_partition_id()), "ranges")

    def run(self, values: dict[str, Value], rows: DataFrame | None = None) -> DataFrame:
        """``rows`` with a running value for each of ``values``: its name, and how (sum, max, min or last that is not null) of
        what it runs, from the first row of its key to this one. A third word may hold ``before`` (up to the row before) and
        ``back`` (from the last row back to this one)."""
        d = self.rows if rows is None else rows
        named = {n: (v[0], v[1], "before" in (v[2] if len(v) > 2 else ""), "back" in (v[2] if len(v) > 2 else "")) for n, v in values.items()}
        d = d.withColumns({f"_v_{n}": c for n, (_, c, _, _) in named.items()})
        ordered = {False: [F.asc(c) for c in self.order], True: [F.desc(c) for c in self.order]}
        names = [c for c in d.columns if not c.startswith("_v_") or c[3:] not in named]

        def inside(before: bool, back: bool, *chunk: str):
            return Window.partitionBy(*self.keys, *chunk).orderBy(*ordered[back]).rowsBetween(Window.unboundedPreceding, -1 if before else 0)

        if not self.hot:
            return d.select(*names, *[_OVER[how](F.col(f"_v_{n}")).over(inside(before, back)).alias(n) for n, (how, _, before, back) in named.items()])
        at = F.struct(*self.order)

        def total(n: str, how: str, back: bool) -> Column:
            v = F.col(f"_v_{n}")
            return ((F.min_by if back else F.max_by)(v, F.when(v.isNotNull(), at)) if how == "last" else _OVER[how](v)).alias(f"_t_{n}")

        totals = d.groupBy(*self.keys, "_chunk").agg(*[total(n, how, back) for n, (how, _, _, back) in named.items()])
        earlier = {back: Window.partitionBy(*self.keys).orderBy(F.desc("_chunk") if back else F.asc("_chunk")).rowsBetween(Window.unboundedPreceding, -1) for back in (False, True)}
        carry = totals.select(*self.keys, "_chunk", *[_OVER[how](F.col(f"_t_{n}")).over(earlier[back]).alias(f"_c_{n}") for n, (how, _, _, back) in named.items()])
        d = d.select("*", *[_OVER[how](F.col(f"_v_{n}")).over(inside(before, back, "_chunk")).alias(f"_i_{n}") for n, (how, _, before, back) in named.items()]).join(carry, [*self.keys, "_chunk"])

        def both(n: str, how: str) -> Column:
            i, c = F.col(f"_i_{n}"), F.col(f"_c_{n}")
            if how == "last":
                return F.coalesce(i, c)
            if how == "sum":
                return F.coalesce(i + c, i, c)
            return (F.greatest if how == "max" else F.least)(i, c)  # both pass over nulls

        return d.select(*names, *[both(n, how).alias(n) for n, (how, _, _, _) in named.items()])

    def done(self, d: DataFrame) -> DataFrame:
        return d.drop("_chunk") if self.hot else d


def running(df: DataFrame, keys: list[str], values: dict[str, Value], chunk: int = CHUNK, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One run of a ``Scan``."""
    s = Scan(df, keys, order, chunk)
    return s.done(s.run(values))
