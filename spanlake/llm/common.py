"""Shared helpers: the cluster's scratch folder, tables that cut lineage, and column shorthands."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import on_workers
from ..tables import materialize, new_path  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each followed by as many underscores as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_held: dict[str, list[Callable[[], None]]] = {}


def hold(name: str, release: Callable[[], None]) -> None:
    """Say that this worker now keeps a cache of operator ``name``; caches of other operators are released.

    A worker serves many stages one after another; what an earlier one kept must not stay beside the next one's.
    """
    for other in [x for x in _held if x != name]:
        for f in _held.pop(other):
            f()
    kept = _held.setdefault(name, [])
    if release not in kept:
        kept.append(release)


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


SLICE_ROWS = 1000
SLICE_BYTES = 1 << 22


def release_memory() -> None:
    """Give freed memory of this worker back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and bytes of text (or of one row), which bound what a worker makes of them.

    Memory goes back to the system after each slice; empty batches are passed over.
    """
    for b in batches:
        if not b.num_rows:
            continue
        bytes_of = np.zeros(b.num_rows, dtype=np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                bytes_of += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(bytes_of)
        s = 0
        while s < b.num_rows:
            fits = int(np.searchsorted(upto, size + (upto[s - 1] if s else 0), side="right"))
            e = min(b.num_rows, s + rows, max(s + 1, fits))
            yield b.slice(s, e - s)
            s = e
            release_memory()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` for a function of one slice of at most ``rows`` rows and ``size`` bytes of text."""
    on_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows, size):
            if (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows go to Python in queries that are run here, which bounds both sides' buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Components of an edge table ``(a, b)`` of longs, as ``(node, component)`` with the least node as name.

    Alternates large-star and small-star steps; every round is one table in the shared folder, nothing but
    one row (a checksum of the edge set) comes to the driver, and no step gathers the members of a component.
    Self-edges may stand for isolated nodes. An empty table gives an empty table.
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    cur = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-e"
    )
    last = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: every larger neighbour of a node is linked to the least node around it
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: every node and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        cur = materialize(small.where("a <> b").distinct(), f"{label}-e")
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"{label}: components did not settle in {max_rounds} rounds")
    roots = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("r"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("r", "node").alias("component"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Groups of a stream that is sorted by its first ``keys`` columns (longs without nulls), each as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and tuple(k[:, 0]) != last:
            yield _joined(held)
            held = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            part = b.slice(s, e - s)
            if e < b.num_rows:
                yield _joined([*held, part])
                held = []
            else:
                held.append(part)
        last = tuple(k[:, -1])
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
