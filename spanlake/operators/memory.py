"""Memory: allocation lifetimes, curves, leaks and rates.

Rows are ``(stream_id, thread_id, seq, date_ns, ptr, kind, size)``; frees book on the allocating thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .intervals import contained
from .scan import CHUNK, running

KEYS = ["stream_id", "thread_id"]


def allocations(df: DataFrame) -> DataFrame:
    """``(stream_id, ptr, alloc_seq, thread_id, size, start_ns, free_seq, free_thread, end_ns)``.

    A free matches if the row of its pointer just before it is an allocation; other frees are unknown. A pointer
    that is used again leaves its older allocation leaked.
    """
    w = Window.partitionBy("stream_id", "ptr").orderBy("seq")
    nxt = lambda c: F.when(F.lead("kind").over(w) == "dealloc", F.lead(c).over(w))
    d = df.select("*", nxt("seq").alias("free_seq"), nxt("thread_id").alias("free_thread"), nxt("date_ns").alias("end_ns"))
    return d.where("kind = 'alloc'").select(
        "stream_id", "ptr", F.col("seq").alias("alloc_seq"), "thread_id", "size", F.col("date_ns").alias("start_ns"), "free_seq", "free_thread", "end_ns"
    )


def leaks(allocs: DataFrame) -> DataFrame:
    return allocs.where("end_ns is null")


def _steps(allocs: DataFrame) -> DataFrame:
    a = allocs.select(*KEYS, F.col("alloc_seq").alias("seq"), F.col("start_ns").alias("date_ns"), F.col("size").alias("step"), F.lit(1).alias("is_alloc"))
    f = allocs.where("free_seq is not null").select(*KEYS, F.col("free_seq").alias("seq"), F.col("end_ns").alias("date_ns"), (-F.col("size")).alias("step"), F.lit(0).alias("is_alloc"))
    return a.unionByName(f)


def memory_curve(allocs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(stream_id, thread_id, seq, date_ns, bytes, allocs, frees)`` after every event, running by allocating thread."""
    one = F.lit(1).cast("long")
    d = running(_steps(allocs), KEYS, {"bytes": ("sum", F.col("step")), "allocs": ("sum", F.col("is_alloc").cast("long")), "frees": ("sum", one - F.col("is_alloc"))}, chunk)
    return d.select(*KEYS, "seq", "date_ns", "bytes", "allocs", "frees")


def alloc_counts(allocs: DataFrame) -> DataFrame:
    return memory_curve(allocs).select(*KEYS, "seq", "allocs", "frees")


def memory_peak(curve: DataFrame) -> DataFrame:
    return curve.groupBy(*KEYS).agg(F.max("bytes").alias("peak_bytes"), F.min_by("date_ns", F.struct(-F.col("bytes"), "seq")).alias("peak_ns"))


def scope_memory(scopes: DataFrame, allocs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Allocations and frees inside each scope, nested scopes included: running sums at its end less those at its begin.

    ``(stream_id, thread_id, scope_id, allocs, bytes, frees, freed_bytes)``; at equal ``seq`` the scope row is first.
    """
    none = F.lit(0).cast("long")
    s = _steps(allocs).select(
        *KEYS, "seq", F.lit(1).alias("_o"), F.col("is_alloc").cast("long").alias("a"), F.when(F.col("is_alloc") == 1, F.col("step")).otherwise(none).alias("b"),
        (1 - F.col("is_alloc")).cast("long").alias("f"), F.when(F.col("is_alloc") == 0, -F.col("step")).otherwise(none).alias("g"), F.lit(None).cast("long").alias("scope_id"), F.lit(0).alias("_e")
    )
    zero = [none.alias(c) for c in "abfg"]
    begin = scopes.select(*KEYS, F.col("scope_id").alias("seq"), F.lit(0).alias("_o"), *zero, "scope_id", F.lit(-1).alias("_e"))
    end = scopes.select(*KEYS, F.coalesce("end_seq", F.lit((1 << 63) - 1)).alias("seq"), F.lit(0).alias("_o"), *zero, "scope_id", F.lit(1).alias("_e"))
    marks = begin.withColumn("_u", F.col("scope_id")).unionByName(end.withColumn("_u", F.col("scope_id"))).unionByName(s.withColumn("_u", F.lit(0).cast("long")))
    d = running(marks, KEYS, {f"_{c}": ("sum", F.col(c)) for c in "abfg"}, chunk, ("seq", "_o", "_u")).where("scope_id is not null")
    d = d.select(*KEYS, "scope_id", "_e", *[F.col(f"_{c}").alias(c) for c in "abfg"])
    return d.groupBy(*KEYS, "scope_id").agg(*[F.sum(F.col(c) * F.col("_e")).alias(n) for c, n in zip("abfg", ("allocs", "bytes", "frees", "freed_bytes"), strict=True)])


def live_at(allocs: DataFrame, dates: DataFrame, bucket_ns: int) -> DataFrame:
    """Allocations alive at each of ``dates(stream_id, at_ns)``: begun by then and not freed yet. Leaks live to the last date."""
    last = F.broadcast(dates.agg(F.max("at_ns").alias("_last")))  # one row
    lives = allocs.join(last).where("start_ns <= _last").withColumn("_gone", F.coalesce(F.col("end_ns") - 1, F.col("_last"))).drop("_last")
    d = contained(lives, dates.select("stream_id", "at_ns").distinct(), ["stream_id"], "start_ns", "_gone", "at_ns", bucket_ns)
    return d.select(*_LIVE)


_LIVE = ["stream_id", "at_ns", "ptr", "alloc_seq", "thread_id", "size"]


def write_snapshots(allocs: DataFrame, path: str, every_ns: int) -> None:
    """Snapshots for ``live_in``: ``live``, the allocations alive at the begin of each chunk of ``every_ns`` (and begun before), and
    ``begun``, those begun in it; both by stream and chunk. A chunk in which no row begins or ends is left out."""
    chunk = lambda c: F.expr(f"({c} - pmod({c}, {every_ns}L)) div {every_ns}L")
    a = allocs.select("stream_id", "ptr", "alloc_seq", "thread_id", "size", "start_ns", "end_ns")
    edges = a.select("stream_id", F.explode(F.array(chunk("start_ns"), chunk("end_ns"))).alias("chunk")).where("chunk is not null").distinct()
    borders = edges.select("stream_id", "chunk", (F.col("chunk") * every_ns - 1).alias("at_ns"))
    held = live_at(a, borders.select("stream_id", "at_ns"), every_ns).join(borders, ["stream_id", "at_ns"]).drop("at_ns")
    held = held.join(a.select("stream_id", "alloc_seq", "start_ns", "end_ns"), ["stream_id", "alloc_seq"])
    for name, d in (("live", held), ("begun", a.withColumn("chunk", chunk("start_ns")))):
        d.repartitionByRange("stream_id", "chunk", "alloc_seq").sortWithinPartitions("stream_id", "chunk", "alloc_seq").write.partitionBy("stream_id", "chunk").parquet(f"{path}/{name}")
    edges.withColumn("every_ns", F.lit(every_ns).cast("long")).repartitionByRange("chunk", "stream_id").write.parquet(f"{path}/chunks")


def live_in(spark: SparkSession, path: str, at_ns: int) -> DataFrame:
    """``live_at`` one date from ``write_snapshots``: for each stream the last snapshot by then and the rows begun in its chunk.

    The last chunk of each stream by then is looked up first, so that the scans read the folders of these chunks alone.
    """
    upto = F.col("chunk") <= F.expr(f"({at_ns}L - pmod({at_ns}L, every_ns)) div every_ns")
    last = spark.read.parquet(f"{path}/chunks").where(upto).groupBy("stream_id").agg(F.max("chunk").alias("chunk")).groupBy("chunk").agg(F.collect_list("stream_id").alias("streams"))
    wanted = F.lit(False)
    for r in last.collect():  # a number a stream
        wanted = wanted | ((F.col("chunk") == r.chunk) & F.col("stream_id").isin(r.streams))
    rows = [spark.read.parquet(f"{path}/{n}").where(wanted) for n in ("live", "begun")]
    alive = rows[0].unionByName(rows[1]).where((F.col("start_ns") <= at_ns) & (F.col("end_ns").isNull() | (F.col("end_ns") > at_ns)))
    cols = {"at_ns": F.lit(at_ns).cast("long"), "stream_id": F.col("stream_id").cast("long")}
    return alive.select(*[cols[c].alias(c) if c in cols else c for c in _LIVE])


def allocs_in_range(allocs: DataFrame, rng: tuple[int, int], only_in_range: bool = False) -> DataFrame:
    a = allocs.where((F.col("start_ns") <= rng[1]) & (F.col("end_ns").isNull() | (F.col("end_ns") >= rng[0])))
    return a.where((F.col("start_ns") >= rng[0]) & (F.col("end_ns") <= rng[1])) if only_in_range else a


def alloc_table(allocs: DataFrame, order_by: str = "size", n: int | None = None) -> DataFrame:
    t = allocs.select(*KEYS, "ptr", "alloc_seq", "size", "start_ns", "free_thread", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), F.col("end_ns").isNull().alias("leaked"))
    t = t.orderBy(F.desc(order_by), "alloc_seq")
    return t if n is None else t.limit(n)


def alloc_rate(allocs: DataFrame, bin_ns: int) -> DataFrame:
    """Calls by time bin, allocations and frees apart."""
    d = _steps(allocs).groupBy(F.floor(F.col("date_ns") / bin_ns).alias("bin")).agg(F.sum("is_alloc").alias("allocs"), F.sum(1 - F.col("is_alloc")).alias("frees"))
    return d
