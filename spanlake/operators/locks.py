"""Locks: uses, waits, notifications, contention and wake-up latency.

Rows are ``(name, stream_id, thread_id, seq, date_ns, kind)``; a lock is known by its stream and name. ``seq`` is the
order of arrival in a stream. States of locks and threads are scans (``scan``), overlaps go by blocks (``intervals``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import exact_longs, materialize
from .intervals import contained
from .scan import CHUNK, running

LOCK = ["stream_id", "name"]
KEYS = ["stream_id", "thread_id"]
ORDER = ["date_ns", "seq"]
MIN_WAIT_NS = 5_000
TASK_ROWS, MOST_TASKS = 1 << 13, 1 << 12


def dedupe_lock_state(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Acquire and release rows that change the lock's state; a lock begins free."""
    use = df.where(F.col("kind").isin("lock_acquired", "lock_released"))
    d = running(use, LOCK, {"_was": ("last", F.col("kind"), "before")}, chunk)
    return d.where(F.col("kind") != F.coalesce("_was", F.lit("lock_released"))).drop("_was")


def lock_uses(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(stream_id, name, thread_id, seq, start_ns, end_ns, held_ns)``; the owner is the acquiring thread, a lock
    never released is held to null. The first release after an acquire changes the lock's state."""
    use = df.where(F.col("kind").isin("lock_acquired", "lock_released"))
    released = F.when(F.col("kind") == "lock_released", F.col("date_ns"))
    d = running(use, LOCK, {"_was": ("last", F.col("kind"), "before"), "end_ns": ("last", released, "before back")}, chunk)
    d = d.where("kind = 'lock_acquired' and coalesce(_was, 'lock_released') <> kind")
    return d.select(*LOCK, "thread_id", "seq", F.col("date_ns").alias("start_ns"), "end_ns", (F.col("end_ns") - F.col("date_ns")).alias("held_ns"))


def wait_ends(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Waiting is a state of the thread: an acquire or release right after its wait began ends that wait."""
    d = df.where(F.col("kind").isin("lock_wait_begin", "lock_wait_end", "lock_acquired", "lock_released"))
    d = running(d, KEYS, {"_p": ("last", F.struct("kind", "date_ns", "name", "seq"), "before")}, chunk)
    d = d.where("kind <> 'lock_wait_begin' and _p.kind = 'lock_wait_begin'")
    return d.select("*", F.col("_p.date_ns").alias("_since"), F.col("_p.name").alias("_lock"), F.col("_p.seq").alias("_seq")).drop("_p")


def lock_waits(df: DataFrame, with_open: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``(stream_id, name, thread_id, seq, start_ns, end_ns, wait_ns)``; the lock is the one waited for.

    ``with_open`` adds the waits that never end, with a null end: a wait begun on which no row of its thread follows.
    """
    d = wait_ends(df, chunk).select(
        "stream_id", F.col("_lock").alias("name"), "thread_id", F.col("_seq").alias("seq"), F.col("_since").alias("start_ns"), F.col("date_ns").alias("end_ns"), (F.col("date_ns") - F.col("_since")).alias("wait_ns")
    )
    if not with_open:
        return d
    states = df.where(F.col("kind").isin("lock_wait_begin", "lock_wait_end", "lock_acquired", "lock_released"))
    last = states.groupBy(*KEYS).agg(F.max_by(F.struct("kind", "name", "seq", "date_ns"), "seq").alias("r")).where("r.kind = 'lock_wait_begin'")
    none = F.lit(None).cast("long")
    return d.unionByName(last.select("stream_id", "r.name", "thread_id", "r.seq", F.col("r.date_ns").alias("start_ns"), none.alias("end_ns"), none.alias("wait_ns")))


def lock_notifications(df: DataFrame) -> DataFrame:
    return df.where("kind = 'lock_notified'").groupBy(*LOCK, "thread_id").agg(F.count("*").alias("n"), F.min("date_ns").alias("first_ns"), F.max("date_ns").alias("last_ns"))


def lock_waiters(df: DataFrame) -> DataFrame:
    """Threads that ever waited for a lock, one row each pair, and their number by lock."""
    pairs = df.where("kind = 'lock_wait_begin'").select(*LOCK, "thread_id").distinct()
    return pairs.groupBy(*LOCK).agg(F.count("*").alias("n_waiters"), F.array_join(F.array_sort(F.collect_list(F.col("thread_id"))), ",").alias("waiters"))


def contention(waits: DataFrame, uses: DataFrame, min_wait_ns: int = MIN_WAIT_NS, bucket_ns: int = 10**9) -> DataFrame:
    """Waits of at least ``min_wait_ns`` with every use of the same lock by another thread that overlaps them.

    Of two intervals that overlap, one holds the start of the other: uses that begin inside a wait, and waits that begin
    inside a use begun before them.
    """
    w = waits.where(F.col("wait_ns") >= min_wait_ns).select(*LOCK, F.col("thread_id").alias("waiter"), F.col("seq").alias("wait_seq"), F.col("start_ns").alias("w0"), F.col("end_ns").alias("w1"))
    u = uses.where("end_ns is not null").select(*LOCK, F.col("thread_id").alias("owner"), F.col("seq").alias("use_seq"), F.col("start_ns").alias("u0"), F.col("end_ns").alias("u1"))
    w, u = materialize(w, "waits"), materialize(u, "uses")
    # a few rows in can be very many out: tasks by rows, which are not merged again for small input
    tasks = max(int(waits.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, (w.count() + u.count()) // TASK_ROWS))
    begun = contained(w, u, LOCK, "w0", "w1", "u0", bucket_ns, tasks)
    held = contained(u, w, LOCK, "u0", "u1", "w0", bucket_ns, tasks).where("u0 < w0")
    j = begun.unionByName(held).where("u0 < w1 and u1 > w0 and owner <> waiter")
    return j.select(*LOCK, "waiter", "wait_seq", "owner", "use_seq", (F.least("w1", "u1") - F.greatest("w0", "u0")).alias("overlap_ns"))


def wakeup_latency(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For every wait, the last notification of its lock before its end and the time from there to the end."""
    ends = lock_waits(df).select(*LOCK, F.col("end_ns").alias("date_ns"), "seq", "thread_id", "start_ns", F.lit(1).alias("_end"))
    told = df.where("kind = 'lock_notified'").select(*LOCK, "date_ns", "seq", "thread_id", F.lit(None).cast("long").alias("start_ns"), F.lit(0).alias("_end"))
    notified = ("last", F.when(F.col("_end") == 0, F.col("date_ns")))
    d = running(ends.unionByName(told), LOCK, {"notified_ns": notified}, chunk, ("date_ns", "_end", "seq")).where("_end = 1")
    return d.select(*LOCK, "thread_id", "seq", "notified_ns", (F.col("date_ns") - F.col("notified_ns")).alias("latency_ns"), (F.col("notified_ns") >= F.col("start_ns")).alias("in_order"))


def median_latency(latencies: DataFrame) -> DataFrame:
    return latencies.where("latency_ns is not null").groupBy(*LOCK).agg(F.count("*").alias("n"), F.percentile("latency_ns", F.lit(0.5)).alias("median_ns"))


def lock_stats(uses: DataFrame, waits: DataFrame) -> DataFrame:
    u = uses.groupBy(*LOCK).agg(F.count("*").alias("uses"), F.min("held_ns").alias("min_held"), F.max("held_ns").alias("max_held"), F.sum(F.col("held_ns").cast("decimal(20,0)")).alias("total_held"))
    w = waits.groupBy(*LOCK).agg(F.count("*").alias("waits"), F.min("wait_ns").alias("min_wait"), F.max("wait_ns").alias("max_wait"), F.sum(F.col("wait_ns").cast("decimal(20,0)")).alias("total_wait"))
    return exact_longs(u.join(w, LOCK, "full").fillna(0, ["uses", "waits"]), ["total_held", "total_wait"], "lock-stats")
