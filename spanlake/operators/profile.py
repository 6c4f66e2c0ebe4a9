"""Profiles: aggregation over call paths, flat tables and flame-graph layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import exact_longs
from .scopes import KEYS


def profile(scopes: DataFrame, kind: str = "time", rng: tuple[int, int] | None = None, scope_id: int | None = None, drop_zero: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Nodes of the call tree: siblings of one name merge. ``(keys, path, depth, calls, value, children, self, first_id, first_ns)``.

    ``kind``: time (durations), bytes or calls (columns ``bytes`` and ``allocs`` of ``scopes``). With ``rng`` the roots
    are the scopes wholly inside, at each thread's first level that has any, under a node of the whole range (empty path,
    depth -1, its value the range's length); with ``scope_id`` the root is one scope.
    """
    s = scopes.withColumn("_v", F.col({"time": "duration_ns", "bytes": "bytes", "calls": "allocs"}[kind]))
    if scope_id is not None:
        s = s.where(F.array_contains("scope_path", F.lit(scope_id).cast("long")))
        root = s.agg(F.min("level").alias("_root"))
        s = s.join(F.broadcast(root)).withColumn("path", F.expr("slice(path, cast(_root + 1 as int), size(path))"))  # one row
    if rng is not None:
        s = s.where((F.col("start_ns") >= rng[0]) & (F.col("end_ns") <= rng[1]))
        s = s.join(s.groupBy(*keys).agg(F.min("level").alias("_root")), keys)
        s = s.withColumn("path", F.expr("slice(path, cast(_root + 1 as int), size(path))"))
    node = s.groupBy(*keys, "path").agg(
        F.count("*").alias("calls"), F.sum("_v").alias("value"), F.min("scope_id").alias("first_id"), F.min_by("start_ns", "scope_id").alias("first_ns")
    )
    # each node stands for itself and adds its value to the children of the path above: one pass over the nodes
    own = F.struct("path", "calls", "value", "first_id", "first_ns", F.lit(0).cast("long").alias("children"))
    none = [F.lit(None).cast(node.schema[c].dataType).alias(c) for c in ("calls", "value", "first_id", "first_ns")]
    above = F.struct(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), *none, F.col("value").alias("children"))
    both = node.select(*keys, F.explode(F.when(F.size("path") > 1, F.array(own, above)).otherwise(F.array(own))).alias("x")).select(*keys, "x.*")
    out = both.groupBy(*keys, "path").agg(*[F.max(c).alias(c) for c in ("calls", "value", "first_id", "first_ns")], F.sum("children").alias("children")).where("calls is not null")
    out = out.withColumn("depth", F.size("path") - 1).withColumn("self", F.col("value") - F.col("children"))
    out = out.where("value <> 0") if drop_zero else out
    out = out.select(*keys, "path", "depth", "calls", "value", "children", "self", "first_id", "first_ns")
    if rng is None:
        return out
    top = out.where("depth = 0").groupBy(*keys).agg(F.sum("value").alias("children"), F.min("first_id").alias("first_id"))
    length = F.lit(rng[1] - rng[0]).cast("long") if kind == "time" else F.col("children")
    whole = top.select(
        *keys, F.array().cast("array<string>").alias("path"), F.lit(-1).alias("depth"), F.lit(1).cast("long").alias("calls"), length.alias("value"), "children",
        (length - F.col("children")).alias("self"), "first_id", F.lit(rng[0]).cast("long").alias("first_ns"),
    )
    return out.unionByName(whole)


def flat_profile(prof: DataFrame, order_by: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row a name: self and inclusive values with their shares of the total self value.

    Inclusive values count a name once where it calls itself (outermost occurrences only). Values of many threads may add up
    to more than a long holds; sums are exact, and a column of such sums is decimal(38,0).
    """
    keys = keys or []
    name = F.element_at("path", -1)
    outer = ~F.array_contains(F.slice("path", F.lit(1), F.size("path") - 1), name)
    p = prof.withColumn("name", name).withColumn("_outer", F.when(outer, F.col("value")).otherwise(0))
    t = p.groupBy(*keys, "name").agg(F.sum("calls").alias("calls"), F.sum(F.col("self").cast("decimal(20,0)")).alias("self"), F.sum(F.col("_outer").cast("decimal(20,0)")).alias("incl"))
    t = t.withColumn("_total", F.sum("self").over(Window.partitionBy(*keys)))  # a row a name
    share = lambda c: F.when(F.col("_total") > 0, F.round(100.0 * F.col(c).cast("double") / F.col("_total").cast("double"), 6))
    t = t.withColumn("self_pct", share("self")).withColumn("incl_pct", share("incl")).drop("_total")
    t = exact_longs(t, ["self", "incl"], "flat")
    return t.orderBy(F.desc(order_by), "name") if order_by else t


def flame_layout(prof: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``prof`` with ``x`` (the parent's offset and its earlier siblings, by case-folded name) and % of the parent."""
    name, parent = F.element_at("path", -1), F.slice("path", F.lit(1), F.size("path") - 1)
    p = prof.withColumn("_parent", parent)
    w = Window.partitionBy(*keys, "_parent").orderBy(F.lower(name), name).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_in", F.coalesce(F.sum("value").over(w), F.lit(0)))
    steps = p.select(*keys, F.col("path").alias("_prefix"), F.col("_in").alias("_step"), F.col("value").alias("_pv"))
    up = p.select(*keys, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("_prefix"))
    sums = up.join(steps, [*keys, "_prefix"]).groupBy(*keys, "path").agg(F.sum("_step").alias("x"), F.max(F.when(F.size("_prefix") == F.size("path") - 1, F.col("_pv"))).alias("_pv"))
    out = p.join(sums, [*keys, "path"])
    pct = F.when(F.col("_pv") > 0, F.round(100.0 * F.col("value") / F.col("_pv"), 6)).when(F.col("_pv").isNull(), 100.0)
    return out.withColumn("parent_pct", pct).drop("_parent", "_in", "_pv")


def find_in_profile(layout: DataFrame, name: str) -> DataFrame:
    return layout.where(F.element_at("path", -1) == name)
