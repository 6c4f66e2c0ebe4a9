"""Time series of a trace: extraction, resolution, histograms.

Series are long: ``(stream_id, thread_id, kind, path, time_ns, seq, value)``, the path a string joined by ``/``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import on_workers
from ..tables import materialize
from .scan import CHUNK, MOST_RANGES, Scan, running

SERIES = ["stream_id", "thread_id", "kind", "path"]
BINS = 20_000
FOLD = 256
SALTS = 16


def series(scopes: DataFrame, data: DataFrame | None = None, uses: DataFrame | None = None, notes: DataFrame | None = None, log_values: DataFrame | None = None) -> DataFrame:
    """All series in one table: scope durations, data at their parent's start, lock hold times, notifications."""
    k = ["stream_id", "thread_id"]
    out = scopes.select(*k, F.lit("scope").alias("kind"), F.array_join("path", "/").alias("path"), F.col("start_ns").alias("time_ns"), F.col("scope_id").alias("seq"), F.col("duration_ns").cast("double").alias("value"))
    if data is not None:
        out = out.unionByName(data.where("time_ns is not null").select(*k, F.lit("data").alias("kind"), F.col("name").alias("path"), "time_ns", "seq", F.col("v_double").alias("value")))
    if uses is not None:
        out = out.unionByName(uses.where("held_ns is not null").select(*k, F.lit("lock_use").alias("kind"), F.col("name").alias("path"), F.col("start_ns").alias("time_ns"), "seq", F.col("held_ns").cast("double").alias("value")))
    if notes is not None:
        out = out.unionByName(notes.where("kind = 'lock_notified'").select(*k, F.lit("notify").alias("kind"), F.col("name").alias("path"), F.col("date_ns").alias("time_ns"), "seq", F.col("thread_id").cast("double").alias("value")))
    if log_values is not None:
        out = out.unionByName(log_values.select(*k, F.lit("log").alias("kind"), F.lit("log").alias("path"), "time_ns", "seq", "value"))
    return out


def select_series(s: DataFrame, path: str, thread: int | None = None) -> DataFrame:
    out = s.where(F.col("path") == path)
    return out if thread is None else out.where(F.col("thread_id") == thread)


def series_stats(s: DataFrame) -> DataFrame:
    return s.groupBy("stream_id", "kind", "path").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("thread_id").alias("threads"))


def read_range(s: DataFrame, rng: tuple[int, int]) -> DataFrame:
    """Points of a range and, for each series, the first point past its end."""
    after = s.where(F.col("time_ns") > rng[1]).groupBy(*SERIES).agg(F.min(F.struct("time_ns", "seq", "value")).alias("p"))
    inside = s.where(F.col("time_ns").between(*rng)).select(*SERIES, "time_ns", "seq", "value")
    return inside.unionByName(after.select(*SERIES, "p.time_ns", "p.seq", "p.value"))


def downsample(s: DataFrame, ns_per_point: int, mode: str = "m4", block: int = 16, chunk: int = CHUNK, fold: int = FOLD) -> DataFrame:
    """``m4``: first, last, least and greatest point of each time bucket. ``exact``: in blocks of ``block`` points the one
    farthest from the point kept before (the first of equals), again and again until a series has at most ``block`` points or
    the mean spacing is reached. ``chunk`` and ``fold`` size its steps and change no result."""
    if mode == "m4":
        p = F.struct("time_ns", "seq", "value")
        b = s.groupBy(*SERIES, F.floor(F.col("time_ns") / ns_per_point).alias("bucket")).agg(
            F.array_distinct(F.array(F.min(p), F.max(p), F.min_by(p, F.struct("value", "time_ns", "seq")), F.max_by(p, F.struct("value", -F.col("time_ns"), -F.col("seq"))))).alias("ps")
        )
        return b.select(*SERIES, F.explode("ps").alias("p")).select(*SERIES, "p.time_ns", "p.seq", "p.value")
    keep = ["time_ns", "seq", "value"]
    s = s.select(*SERIES, *keep).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in SERIES]))

    def ends(d: DataFrame) -> tuple[DataFrame, Row]:
        spacing = (F.max("time_ns") - F.min("time_ns")) / F.greatest(F.lit(1), F.count("*") - 1)
        enough = F.coalesce((F.count("*") <= block) | (spacing >= ns_per_point), F.lit(False))
        at = materialize(d.groupBy(*SERIES).agg(F.count("*").alias("n"), enough.alias("enough")), "series")
        return at, at.agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.bool_or("enough").alias("some"), F.bool_and("enough").alias("every")).first()

    at, all_ = ends(s)
    if all_.every is not False:
        return s
    out = []
    d = _numbered(s, all_.most, all_.rows, chunk)
    while all_.every is False:
        if all_.some:
            # a series of most of the points is met in as many tasks as there are salts
            salted = at.select(*SERIES, "enough", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            points = d.withColumn("salt", F.pmod("i", F.lit(SALTS)).cast("int"))
            done, d = (points.join(salted.where(F.col("enough") == end), [*SERIES, "salt"], "left_semi").drop("salt") for end in (True, False))
            out.append(done)
        d = materialize(_farthest(d, block, fold), "points")
        at, all_ = ends(d)
    return reduce(DataFrame.unionByName, [*out, d]).select(*SERIES, *keep)


def _numbered(s: DataFrame, most: int, rows: int, chunk: int) -> DataFrame:
    """``s`` with ``i``: 0, 1, ... in each series by time, ``seq`` and value. ``most`` is the largest series' number of rows.

    If that is over ``chunk``, rows are dealt to sorted ranges, in which a row's place is known as it is written; what a series
    has before a range comes from a table of a row a series and range.
    """
    order = ["time_ns", "seq", "value"]
    if most <= chunk:
        i = F.row_number().over(Window.partitionBy(*SERIES).orderBy(*order)) - 1
        return materialize(s.withColumn("i", i.cast("long")), "points")
    ranges = s.repartitionByRange(min(MOST_RANGES, -(-rows // chunk)), *SERIES, *order).sortWithinPartitions(*SERIES, *order)
    d = materialize(ranges.withColumn("_place", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_place", 33))
    totals = d.groupBy(*SERIES, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*SERIES).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    bases = materialize(totals.select(*SERIES, "_range", base.alias("_base")), "bases")
    return d.join(bases, [*SERIES, "_range"]).select(*SERIES, *order, (F.col("_place") + F.col("_base")).alias("i"))


def _farthest(d: DataFrame, block: int, fold: int) -> DataFrame:
    """One level of the exact downsample over points numbered by ``i``: a point for each block, numbered by its block.

    Which point a block keeps depends on the block before it only through the point kept there, so a block is a map from
    the few places before it to its own; maps are composed, not followed one after another. ``fold`` blocks and the one before
    them go through one Arrow slice, which gives each block's points with the places before the group from which they are kept
    (mostly all), and the group's map; the maps of groups tell which of these places it is.
    """
    on_workers(d.sparkSession)
    group, last = F.expr(f"i div {block * fold}"), F.expr(f"i div {block} % {fold} = {fold - 1}")
    groups = F.explode(F.when(last, F.array(group, group + 1)).otherwise(F.array(group)))
    by = ["g", *SERIES]
    rows = d.select(groups.alias("g"), *SERIES, "i", "time_ns", "seq", "value")
    own = {f.name: f for f in rows.schema}
    schema = StructType([*[own[c] for c in by], StructField("b", LongType()), *[own[c] for c in ("time_ns", "seq", "value")], *StructType.fromDDL("starts array<int>, f array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, len(by)):
            yield from _kept(t, len(by), block, fold).to_batches()

    found = materialize(rows.repartition(*by).sortWithinPartitions(*by, "i").mapInArrow(run, schema), "farthest")
    maps = found.where(F.size("f") > 0).select(*SERIES, F.col("g").alias("b"), "f")
    first = F.lit(0)
    if maps.limit(1).count():
        places = _followed(maps, fold).select(*SERIES, (F.col("b") + 1).alias("g"), F.col("at").alias("first"))
        found = found.join(places, by, "left")
        first = F.coalesce("first", F.lit(0))
    kept = found.where((F.size("starts") == 0) | F.array_contains("starts", first))
    return kept.select(*SERIES, "time_ns", "seq", "value", F.col("b").alias("i"))


def _changes(t: pa.Table, keys: int) -> np.ndarray:
    """Where the first ``keys`` columns differ from the row before; the first row does."""
    out = np.zeros(t.num_rows, dtype=bool)
    out[:1] = True
    for c in t.columns[:keys]:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of at least so many rows, but the last, which cut no group of a stream that is sorted by its first ``keys`` columns."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_changes(t, keys))[-1])
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _kept(t: pa.Table, keys: int, block: int, fold: int) -> pa.Table:
    """The points that blocks of whole groups may keep. Columns: the group's number and its other keys, ``i``, time, ``seq``, value.

    ``starts`` are the places before the group from which a point is kept; none stands for all. ``f`` is the group's map, beside
    the point that its last block keeps from place 0. Nulls are passed over; where there is nothing else, or the point before is
    one, a block keeps its first point.
    """
    g, i, value = t.column(0).to_numpy(), t.column("i").to_numpy(), t.column("value")
    new, b = _changes(t, keys), i // block
    cut = new.copy()
    cut[1:] |= b[1:] != b[:-1]
    at = np.flatnonzero(cut)
    b, own = b[at], b[at] >= g[at] * fold  # others are blocks before a group
    inside = np.arange(block) < np.diff(at, append=len(i))[:, None]
    place = np.minimum(at[:, None] + np.arange(block), len(i) - 1)
    live = inside & value.is_valid().to_numpy()[place]
    p = (pc.fill_null(value, pa.scalar(0).cast(value.type)) if value.null_count else value).to_numpy()[place]
    was, knew, begin = np.roll(p, 1, axis=0), np.roll(live, 1, axis=0), b == 0
    was[begin], knew[begin] = p[begin, :1], live[begin, :1]
    f = np.empty((len(at), block), dtype=np.int64)
    step = max(1, (1 << 17) // block**2)
    with np.errstate(invalid="ignore", over="ignore"):
        for s in range(0, len(at), step):
            e = slice(s, s + step)
            far = np.abs(p[e, None, :] - was[e, :, None])
            far[np.broadcast_to(~live[e, None, :], far.shape)] = -1
            f[e] = np.where(knew[e], far.argmax(axis=2), 0)
    start = own.copy()
    start[1:] &= new[at][1:] | ~own[:-1]
    k = np.arange(len(at))
    since = np.where(own, k - np.maximum.accumulate(np.where(start, k, 0)), -1)
    step = 1
    while (later := np.flatnonzero(since >= step)).size:  # f[k] becomes the map of the last 2, 4, 8, ... blocks of a group
        f[later] = np.take_along_axis(f[later], f[later - step], axis=1)
        step *= 2
    same = (f == f[:, :1]).all(axis=1)
    one, many = np.flatnonzero(own & same), np.flatnonzero(own & ~same)
    code = (many[:, None] * block + f[many]).ravel()
    order = np.argsort(code, kind="stable")
    code = code[order]
    run = np.flatnonzero(np.diff(code, prepend=-1))
    k = np.concatenate((one, code[run] // block))
    to = np.concatenate((f[one, 0], code[run] % block))
    offsets = np.concatenate((np.zeros(len(one), np.int64), run, [len(code)]))
    ends = (b[k] % fold == fold - 1) & (to == f[k, 0])
    lists = [
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((order % block).astype(np.int32))),
        pa.ListArray.from_arrays(pa.array((np.concatenate(([0], np.cumsum(ends))) * block).astype(np.int32)), pa.array(f[k[ends]].ravel().astype(np.int32))),
    ]
    points = t.select(["time_ns", "seq", "value"]).take(pa.array(at[k] + to))
    names = t.column_names[:keys]
    return pa.table([*t.select(names).take(pa.array(at[k])).columns, pa.array(b[k]), *points.columns, *lists], [*names, "b", *points.column_names, "starts", "f"])


def _followed(maps: DataFrame, fold: int) -> DataFrame:
    """``(series, b, at)`` of ``(series, b, f)``: ``at`` of a block is its map at the place of the block before, beginning at place 0.

    ``fold`` maps after one another become one; these are followed in the same way, and give each group its first place.
    """
    groups = materialize(maps.groupBy(*SERIES, F.expr(f"b div {fold}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("b", "f"))).alias("fs")), "maps")
    more = groups.where("g > 0").limit(1).count()
    if more:
        composed = F.aggregate(F.slice("fs", F.lit(2), F.size("fs")), F.get("fs", 0)["f"], lambda acc, x: F.transform(acc, lambda i: F.get(x["f"], i)))
        last = _followed(groups.select(*SERIES, F.col("g").alias("b"), composed.alias("f")), fold)
        groups = groups.join(last.select(*SERIES, (F.col("b") + 1).alias("g"), F.col("at").alias("first")), [*SERIES, "g"], "left")
    first = F.coalesce("first", F.lit(0)) if more else F.lit(0)
    start = F.struct(F.array().cast("array<int>").alias("seen"), first.alias("at"))

    def step(acc: Column, x: Column) -> Column:
        at = F.get(x["f"], acc["at"])
        return F.struct(F.concat(acc["seen"], F.array(at)).alias("seen"), at.alias("at"))

    places = F.aggregate("fs", start, step)["seen"]
    out = groups.select(*SERIES, F.explode(F.arrays_zip(F.col("fs.b").alias("b"), places.alias("at"))).alias("x"))
    return out.select(*SERIES, "x.b", "x.at")


def merge_scopes(scopes: DataFrame, min_gap_ns: int, chunk: int = CHUNK) -> DataFrame:
    """Scopes of one thread and level that are closer than ``min_gap_ns`` fuse: ``(..., start_ns, end_ns, n)``."""
    k = ["stream_id", "thread_id", "level"]
    s = Scan(scopes, k, ("start_ns", "scope_id"), chunk)
    d = s.run({"_upto": ("max", F.col("end_ns"), "before")})
    far = F.coalesce(F.col("start_ns") - F.col("_upto") >= min_gap_ns, F.lit(True))
    d = s.run({"_g": ("sum", F.when(far, 1).otherwise(0))}, d)
    return d.groupBy(*k, "_g").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n")).drop("_g")


def scope_pyramid(scopes: DataFrame, leaf: int = 4, factor: int = 8, levels: int = 6, chunk: int = CHUNK) -> DataFrame:
    """Scopes at several resolutions ``(stream_id, thread_id, level, res, block, start_ns, end_ns, n, scope_id, speck_ns, upper_ns)``.

    At ``res`` -1 stand the scopes themselves, at 0 blocks of ``leaf`` successive scopes of a thread and level, then
    blocks of ``factor`` blocks. ``speck_ns`` is the longest scope or gap of a block (with the gap before it; 0 for a scope itself): where
    that cannot be seen the block looks like one scope, the first one of which it names. ``upper_ns`` is the speck of the block above, which is none less.
    """
    k = ["stream_id", "thread_id", "level"]
    one = F.lit(1).cast("long")
    d = running(scopes.select(*k, "scope_id", "start_ns", "end_ns"), k, {"i": ("sum", one), "_was": ("last", F.col("end_ns"), "before")}, chunk, ("start_ns", "scope_id"))
    longest = F.greatest(F.col("end_ns") - F.col("start_ns"), F.coalesce(F.col("start_ns") - F.col("_was"), F.lit(0)))
    d = d.select(*k, "scope_id", "start_ns", "end_ns", F.expr(f"(i - 1) div {leaf}").alias("b"), longest.alias("speck_ns"))
    d = materialize(d, "scopes")
    span = F.explode(F.array(*[F.struct(F.lit(r).alias("res"), F.lit(factor**r).cast("long").alias("ratio")) for r in range(levels)])).alias("x")
    coarse = d.groupBy(*k, "b").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n"), F.min("scope_id").alias("scope_id"), F.max("speck_ns").alias("speck_ns"))
    coarse = coarse.select("*", span).groupBy(*k, F.col("x.res").alias("res"), F.expr("b div x.ratio").alias("block")).agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("n").alias("n"), F.min("scope_id").alias("scope_id"), F.max("speck_ns").alias("speck_ns")
    )
    coarse = materialize(coarse, "pyramid")
    fine = d.select(*k, F.lit(-1).alias("res"), F.col("scope_id").alias("block"), "start_ns", "end_ns", one.alias("n"), "scope_id", F.lit(0).cast("long").alias("speck_ns"), F.lit(0).alias("up"), F.col("b").alias("up_block"))
    blocks = coarse.select(*k, "res", "block", "start_ns", "end_ns", "n", "scope_id", "speck_ns", (F.col("res") + 1).alias("up"), F.expr(f"block div {factor}").alias("up_block"))
    above = coarse.select(*k, F.col("res").alias("up"), F.col("block").alias("up_block"), F.col("speck_ns").alias("upper_ns"))
    out = fine.unionByName(blocks).join(above, [*k, "up", "up_block"], "left")
    return out.select(*k, "res", "block", "start_ns", "end_ns", "n", "scope_id", "speck_ns", F.coalesce("upper_ns", F.lit((1 << 63) - 1)).alias("upper_ns"))


def write_pyramid(pyramid: DataFrame, path: str) -> None:
    """By resolution, and sorted so that a reader's bounds skip row groups."""
    pyramid.repartitionByRange("res", "upper_ns", "start_ns").sortWithinPartitions("res", "upper_ns", "start_ns").write.partitionBy("res").parquet(path)


def read_pyramid(pyramid: DataFrame, speck_ns: int, rng: tuple[int, int] | None = None) -> DataFrame:
    """Every scope once at a resolution: the coarsest blocks whose longest scope and gap are at most ``speck_ns``, and scopes
    that are in none. Two bounds on a row pick it, so they reach the scan of a written pyramid."""
    d = pyramid.where((F.col("speck_ns") <= speck_ns) & (F.col("upper_ns") > speck_ns))
    return d if rng is None else d.where((F.col("start_ns") <= rng[1]) & (F.col("end_ns") >= rng[0]))


def build_rollups(s: DataFrame, base_ns: int, factor: int = 16, levels: int = 4) -> DataFrame:
    """Rollups by buckets of ``base_ns * factor**level``: count, sum, least, greatest, first and last value."""
    span = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(factor**k).alias("ratio")) for k in range(levels)]))
    fine = s.groupBy(*SERIES, F.floor(F.col("time_ns") / base_ns).alias("_b")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min(F.struct("time_ns", "seq", "value")).alias("first"), F.max(F.struct("time_ns", "seq", "value")).alias("last"),
    )
    d = fine.withColumn("_s", span).withColumn("bucket", F.floor(F.col("_b") / F.col("_s.ratio")))
    return d.groupBy(*SERIES, F.col("_s.level").alias("level"), "bucket").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last")
    ).select(*SERIES, "level", "bucket", "n", "total", "lo", "hi", F.col("first.value").alias("first"), F.col("last.value").alias("last"))


def pick_level(ns_per_point: int, base_ns: int, factor: int = 16, levels: int = 4) -> int:
    """The coarsest rollup level whose buckets are no wider than ``ns_per_point``."""
    k = 0
    while k + 1 < levels and base_ns * factor ** (k + 1) <= ns_per_point:
        k += 1
    return k


def read_at(s: DataFrame, rollups: DataFrame, rng: tuple[int, int], ns_per_point: int, base_ns: int, factor: int = 16, levels: int = 4) -> DataFrame:
    """``(series, time_ns, n, lo, hi, value)`` of a range at a resolution: the buckets of the coarsest rollup that is fine
    enough (``time_ns`` is a bucket's begin, ``value`` its last), or the points themselves where no rollup is.

    Buckets that touch the range are whole.
    """
    if ns_per_point < base_ns:
        d = s.where(F.col("time_ns").between(*rng))
        return d.select(*SERIES, "time_ns", F.lit(1).cast("long").alias("n"), F.col("value").alias("lo"), F.col("value").alias("hi"), "value")
    k = pick_level(ns_per_point, base_ns, factor, levels)
    width = base_ns * factor**k
    d = rollups.where((F.col("level") == k) & F.col("bucket").between(rng[0] // width, rng[1] // width))
    return d.select(*SERIES, (F.col("bucket") * width).alias("time_ns"), "n", "lo", "hi", F.col("last").alias("value"))


def histogram(s: DataFrame, bins: int = BINS, rng: tuple[int, int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """``(keys, bin, n, lo, hi, peak, peak_ns, peak_thread)`` of non-empty bins, over the bounds of the full series."""
    keys = keys or ["kind", "path"]
    bounds = s.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = s if rng is None else s.where(F.col("time_ns").between(*rng))
    d = d.join(bounds, keys)
    wide = F.col("hi") > F.col("lo")
    at = F.when(wide, F.floor((F.col("value") - F.col("lo")) * bins / F.when(wide, F.col("hi") - F.col("lo")) + 0.5)).otherwise(0)
    d = d.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("long"))
    best = F.struct("value", -F.col("time_ns"), -F.col("seq"))
    return d.groupBy(*keys, "bin", "lo", "hi").agg(
        F.count("*").alias("n"), F.max("value").alias("peak"), F.max_by("time_ns", best).alias("peak_ns"), F.max_by("thread_id", best).alias("peak_thread")
    )


def discrete_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def rebin(hist: DataFrame, bins: int = BINS, target: int = 50, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["kind", "path"]
    f = -(-bins // target)
    return hist.groupBy(*keys, F.floor(F.col("bin") / f).alias("bar")).agg(F.sum("n").alias("n"), F.max("peak").alias("peak"))


def cumulative(hist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["kind", "path"]
    w = Window.partitionBy(*keys).orderBy("bin")
    all_n = F.sum("n").over(Window.partitionBy(*keys))
    up = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return hist.select(*keys, "bin", "n", up.alias("upto"), F.round(100.0 * up / all_n, 6).alias("upto_pct"))


def binned_stats(hist: DataFrame, bins: int = BINS, keys: list[str] | None = None) -> DataFrame:
    """Mean of bin centres and the median bin: the first whose doubled running count reaches the total."""
    keys = keys or ["kind", "path"]
    c = cumulative(hist, keys).join(hist.select(*keys, "bin", "lo", "hi"), [*keys, "bin"])
    total = c.groupBy(*keys).agg(F.max("upto").alias("_n"))
    c = c.join(total, keys)
    v = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    return c.groupBy(*keys).agg(F.first("_n").alias("n"), (F.sum(v * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(2 * F.col("upto") >= F.col("_n"), F.col("bin"))).alias("median_bin"))


def plottable(scopes: DataFrame, data: DataFrame, scope_id: int) -> DataFrame:
    """Series that a scope offers for plotting: its own and those of its attributes, each once."""
    own = scopes.where(F.col("scope_id") == scope_id).select(F.lit("scope").alias("kind"), "name")
    attrs = data.where(F.col("parent_id") == scope_id).select(F.lit("data").alias("kind"), "name")
    return own.unionByName(attrs).dropDuplicates()
