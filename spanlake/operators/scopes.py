"""Scope trees: pairing of begin and end events, parents, call paths and summaries.

Arrival order inside a thread is ``seq``, whatever the dates are; where dates go back, repair them first
(``clock.monotonic_dates``). Depths, pairs, parents and paths come from ``stacks``: a range of the trace is followed at once and
ranges know each other through a row a range, so that no thread is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import contained
from .scan import CHUNK, running
from .stacks import Stacks

KEYS = ["stream_id", "thread_id"]
ORDER = ["date_ns", "seq"]


def depths(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``df`` with ``orphan`` (an end without a begin), ``depth`` after the row and ``level`` of the row."""
    return Stacks(df, keys, paths=False).rows()


def orphan_ends(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return depths(df, keys).where("orphan").select(*keys, "seq", "date_ns", "name")


def pair_scopes(df: DataFrame, keys: list[str] = KEYS, max_level: int | None = None, close_open: bool = True) -> DataFrame:
    """One row a scope: its id is the ``seq`` of its begin. Open scopes end at their stream's last date."""
    return _scope_rows(Stacks(df, keys, paths=False).scopes(close_open=close_open), keys, max_level)


def _scope_rows(p: DataFrame, keys: list[str], max_level: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    if max_level is not None:
        p = p.where(F.col("level") < max_level)
    return p.select(
        *keys,
        F.col("seq").alias("scope_id"),
        "level",
        "name",
        F.col("date_ns").alias("start_ns"),
        F.col("_end").alias("end_ns"),
        (F.col("_end") - F.col("date_ns")).alias("duration_ns"),
        "is_open",
        "end_name",
        F.coalesce((F.col("end_name") != "") & (F.col("end_name") != F.col("name")), F.lit(False)).alias("mismatch"),
        "end_seq",
        *more,
    )


_ENDS = ("_end_seq", "_end_ns", "_end_name")


def with_paths(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Begin and data rows with ``level``, ``parent_id``, ``path`` (names from the root) and ``scope_path`` (their ids)."""
    return Stacks(df, keys).located().drop(*_ENDS)


def scopes_with_paths(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``pair_scopes`` with ``parent_id``, ``path`` and ``scope_path``."""
    return _scopes_with_paths(Stacks(df, keys), keys)


def _scopes_with_paths(st: Stacks, keys: list[str]) -> DataFrame:
    return _scope_rows(st.scopes(st.located()), keys, more=("parent_id", "path", "scope_path"))


def attach_data(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Data events with their enclosing scope and its start; flat events (outside any scope) have none."""
    return _attached(Stacks(df, keys), keys)


def _attached(st: Stacks, keys: list[str]) -> DataFrame:
    d = st.located(start=True).where("kind = 'data'")
    return d.select(*keys, "seq", "date_ns", "name", "v_double", "level", "parent_id", F.col("up_ns").alias("time_ns"))


def scopes_and_data(df: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """``scopes_with_paths`` and ``attach_data`` of one trace, whose stacks are followed once."""
    st = Stacks(df, keys)
    return _scopes_with_paths(st, keys), _attached(st, keys)


def flat_events(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return depths(df, keys).where("kind = 'data' and depth = 0").select(*keys, "seq", "name")


def children(scopes: DataFrame, data: DataFrame, what: str = "both", limit: int | None = None) -> DataFrame:
    """Direct children ``(stream_id, thread_id, parent_id, child_seq, is_scope, name)`` in arrival order.

    ``what``: scopes, attributes or both; ``limit`` caps the children of one parent.
    """
    s = scopes.where("parent_id is not null").select(*KEYS, "parent_id", F.col("scope_id").alias("child_seq"), F.lit(True).alias("is_scope"), "name")
    a = data.where("parent_id is not null").select(*KEYS, "parent_id", F.col("seq").alias("child_seq"), F.lit(False).alias("is_scope"), "name")
    out = s if what == "scopes" else a if what == "attributes" else s.unionByName(a)
    if limit is not None:
        w = Window.partitionBy(*KEYS, "parent_id").orderBy("child_seq")
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return out


def ancestors(scopes: DataFrame) -> DataFrame:
    """``(scope_id, ancestor_id, distance, ancestor_duration_ns)`` for every enclosing scope."""
    up = scopes.select(*KEYS, "scope_id", F.posexplode("scope_path").alias("at", "ancestor_id"), F.size("scope_path").alias("n"))
    up = up.where("ancestor_id <> scope_id").withColumn("distance", F.col("n") - 1 - F.col("at"))
    dur = scopes.select(*KEYS, F.col("scope_id").alias("ancestor_id"), F.col("duration_ns").alias("ancestor_duration_ns"))
    return up.join(dur, [*KEYS, "ancestor_id"]).select(*KEYS, "scope_id", "ancestor_id", "distance", "ancestor_duration_ns")


def text_order(df: DataFrame, start: int | None = None, n: int | None = None) -> DataFrame:
    """Events of all threads in depth-first order: arrival order is depth-first already."""
    out = df if start is None else df.where(F.col("seq") >= start)
    out = out.orderBy(*KEYS, *ORDER)
    return out if n is None else out.limit(n)


def text_positions(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``position``: the place of each event in the text order of its thread, from 1."""
    return running(df, KEYS, {"position": ("sum", F.lit(1).cast("long"))}, chunk, tuple(ORDER))


def previous(df: DataFrame, seq: int, n: int) -> DataFrame:
    """The last n events before ``seq``, latest first."""
    return df.where(F.col("seq") < seq).orderBy(F.desc("date_ns"), F.desc("seq")).limit(n)


def locate(scopes: DataFrame, dates: DataFrame, bucket_ns: int, chunk: int = CHUNK) -> DataFrame:
    """The deepest scope of every thread that contains a date, else the scope with the closest begin or end.

    ``dates(stream_id, thread_id, at_ns)``. Containment goes by blocks of time (``intervals``); dates without a containing
    scope are matched to the nearest edge by a scan in both directions.
    """
    s = scopes.select(*KEYS, "scope_id", "level", "start_ns", "end_ns")
    d = dates.select(*KEYS, "at_ns").distinct()
    hit = contained(s, d, KEYS, "start_ns", "end_ns", "at_ns", bucket_ns)
    inside = hit.groupBy(*KEYS, "at_ns").agg(F.max_by("scope_id", F.struct("level", "scope_id")).alias("inside"))
    edges = s.select(*KEYS, F.explode(F.array("start_ns", "end_ns")).alias("t"), "scope_id")
    marks = edges.select(*KEYS, "t", "scope_id", F.lit(None).cast("long").alias("at_ns")).unionByName(d.select(*KEYS, F.col("at_ns").alias("t"), F.lit(None).cast("long").alias("scope_id"), "at_ns"))
    edge = F.when(F.col("scope_id").isNotNull(), F.struct("t", "scope_id"))
    marks = running(marks, KEYS, {"lo": ("last", edge), "hi": ("last", edge, "back")}, chunk, ("t", "at_ns", "scope_id"))
    near = marks.where("at_ns is not null").select(
        *KEYS, "at_ns", F.when(F.col("hi").isNull() | (F.col("t") - F.col("lo.t") <= F.col("hi.t") - F.col("t")), F.col("lo.scope_id")).otherwise(F.col("hi.scope_id")).alias("near")
    )
    return near.join(inside, [*KEYS, "at_ns"], "left").select(*KEYS, "at_ns", F.coalesce("inside", "near").alias("scope_id"), F.col("inside").isNotNull().alias("contained"))


def overlapping(scopes: DataFrame, rng: tuple[int, int], level: int | None = None) -> DataFrame:
    out = scopes.where((F.col("start_ns") <= rng[1]) & (F.col("end_ns") >= rng[0]))
    return out if level is None else out.where(F.col("level") == level)


def summarize_scopes(scopes: DataFrame, data: DataFrame, mem: DataFrame | None = None) -> DataFrame:
    """Child count, time in children (share of the duration), the child name with most time, and data count by scope; with
    ``mem`` (``memory.scope_memory``) also its allocations, frees and bytes.

    Scopes, children and data go through one aggregate by scope and name and one by scope.
    """
    none, extra = F.lit(None).cast("long"), ("allocs", "bytes", "frees", "freed_bytes") if mem is not None else ()
    row = lambda df, scope, what, name, t, *more: df.select(*KEYS, F.col(scope).alias("scope_id"), F.lit(what).alias("what"), name, t.alias("t"), *(more or [none.alias(c) for c in extra]))
    parts = [
        row(scopes, "scope_id", "self", F.col("name"), F.col("duration_ns")),
        row(scopes.where("parent_id is not null"), "parent_id", "kid", F.col("name"), F.col("duration_ns")),
        row(data.where("parent_id is not null"), "parent_id", "data", F.lit(None).cast("string").alias("name"), none),
    ]
    if mem is not None:
        parts.append(row(mem, "scope_id", "mem", F.lit(None).cast("string").alias("name"), none, *[F.col(c).cast("long").alias(c) for c in extra]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    by_name = rows.groupBy(*KEYS, "scope_id", "what", "name").agg(F.count("*").alias("n"), F.sum("t").alias("t"), *[F.sum(c).alias(c) for c in extra])
    of = lambda what, c: F.when(F.col("what") == what, F.col(c))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    out = by_name.groupBy(*KEYS, "scope_id").agg(
        F.max(of("self", "name")).alias("name"), F.max(of("self", "t")).alias("duration_ns"), zero(of("kid", "n")).alias("n_children"), zero(of("kid", "t")).alias("children_ns"),
        F.min_by("name", F.when(F.col("what") == "kid", F.struct(-F.col("t"), "name"))).alias("top_child"), zero(of("data", "n")).alias("n_data"),
        F.max(F.col("what") == "self").alias("_known"), *[zero(c).alias(c) for c in extra],
    ).where("_known").drop("_known")
    return out.withColumn("children_pct", F.when(F.col("duration_ns") > 0, F.round(100.0 * F.col("children_ns") / F.col("duration_ns"), 6)))


def children_by_name(scopes: DataFrame) -> DataFrame:
    """``(stream_id, thread_id, scope_id, name, n, children_ns, children_pct, place)``: the children of each scope by name, and
    the name's place among them, most time first."""
    kids = scopes.where("parent_id is not null").groupBy(*KEYS, F.col("parent_id").alias("scope_id"), "name").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("children_ns"))
    of = scopes.select(*KEYS, "scope_id", "duration_ns")
    w = Window.partitionBy(*KEYS, "scope_id").orderBy(F.desc("children_ns"), "name")  # a row a name
    out = kids.join(of, [*KEYS, "scope_id"])
    pct = F.when(F.col("duration_ns") > 0, F.round(100.0 * F.col("children_ns") / F.col("duration_ns"), 6))
    return out.select(*KEYS, "scope_id", "name", "n", "children_ns", pct.alias("children_pct"), F.row_number().over(w).alias("place"))


def instrumentation_errors(df: DataFrame, max_level: int | None = None, max_threads: int | None = None) -> DataFrame:
    """``(type, stream_id, thread_id, name[, file, line], n)`` of orphan ends, name mismatches, events outside scopes, and
    depths and threads over a limit; file and line where ``df`` has them."""
    st = Stacks(df, KEYS, paths=False)
    d, ended = st.rows(), st.scopes()
    at = [c for c in ("file", "line") if c in df.columns]
    cols = [*KEYS, "name", *at]
    parts = [
        d.where("orphan").select(F.lit("orphan_end").alias("type"), *cols),
        d.where("kind = 'data' and depth = 0").select(F.lit("flat_event").alias("type"), *cols),
        ended.where("end_name <> '' and end_name <> name").select(F.lit("name_mismatch").alias("type"), *cols),
    ]
    if max_level is not None:
        parts.append(d.where((F.col("kind") == "scope_begin") & (F.col("level") >= max_level)).select(F.lit("max_level").alias("type"), *cols))
    if max_threads is not None:
        first = df.groupBy(*KEYS).agg(F.min_by(F.struct("seq", *at), "seq").alias("first"))
        w = Window.partitionBy("stream_id").orderBy("first.seq", "thread_id")  # a row a thread
        over = first.withColumn("n", F.row_number().over(w)).where(F.col("n") > max_threads)
        parts.append(over.select(F.lit("max_threads").alias("type"), *KEYS, F.lit("").alias("name"), *[F.col(f"first.{c}").alias(c) for c in at]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("type", *cols).agg(F.count("*").alias("n"))
