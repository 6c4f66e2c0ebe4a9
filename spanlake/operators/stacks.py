"""Stacks of open scopes along a trace, in chunks that know each other through a table of one row a chunk.

The rows are dealt to ranges of (keys, ``seq``), so that a thread with most of the events is many ranges, and a range holds
whole threads but for its first and last one. What a range does to the stack of a thread is the number of ends that close
nothing of its own and the scopes that it leaves open. Chained along the ranges of a thread, these give the stack on which
each range begins: at most one row a range, that is broadcast. A row's ancestors are then the stack it began with, as far as
it was not closed yet, and the ones that its range opened.

Inside a batch of a range nothing runs row by row: depths are prefix sums, the enclosing scope of a row is the last begin of
the level above it, found by a binary search in the begins sorted by level, and ancestors are followed a level at a time
for all rows together. Built-in functions have no stack, and a window for each level of nesting costs rows times levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import on_workers
from ..tables import materialize

_OPEN = "array<struct<name:string,id:bigint,ns:bigint>>"
_MORE = f"_part int, _under bigint, _local int, _below boolean, _late boolean, _closes bigint, _up_ns bigint, _end_seq bigint, _end_ns bigint, _end_name string, _names array<string>, _ids array<bigint>, _effect {_OPEN}"


class _Range:
    """Walks through the batches of one range, which is sorted by the keys and ``seq``."""

    def __init__(self, keys: list[str], schema: pa.Schema, columns: list[str], paths: bool):
        self.keys, self.schema, self.columns, self.paths = keys, schema, columns, paths
        self.part = TaskContext.get().partitionId()
        self.key: tuple | None = None
        self.first = True  # the thread at hand may have begun in an earlier range
        self.open: list[tuple] = []
        self.under = 0

    def effect(self) -> pa.RecordBatch:
        """What the range did to the stack of the thread at hand."""
        row = dict.fromkeys(self.schema.names) | dict(zip(self.keys, self.key, strict=True))
        stack = [{"name": n, "id": i, "ns": d} for n, i, d in self.open]
        return pa.RecordBatch.from_pylist([row | {"_part": self.part, "_under": self.under, "_effect": stack}], self.schema)

    def rows(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = b.num_rows
        change = np.zeros(n, dtype=bool)
        for k in self.keys:
            c = b.column(k)
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        key_at = lambda i: tuple(b.column(k)[i].as_py() for k in self.keys)
        if key_at(0) != self.key:
            if self.key is not None:
                if self.first:
                    yield self.effect()
                self.first = False
            self.key, self.open, self.under = key_at(0), [], 0
        # the scopes that are open stand as begins before the batch
        m = len(self.open)
        kind = b.column("kind")
        begin = np.concatenate([np.ones(m, bool), pc.fill_null(pc.equal(kind, "scope_begin"), False).to_numpy(zero_copy_only=False)])
        end = np.concatenate([np.zeros(m, bool), pc.fill_null(pc.equal(kind, "scope_end"), False).to_numpy(zero_copy_only=False)])
        size = n + m
        run = np.concatenate([np.zeros(m, np.int64), np.cumsum(change)])
        starts = np.concatenate([[0], m + np.flatnonzero(change)])
        s = np.cumsum(begin.astype(np.int64) - end)
        s -= np.concatenate([[0], s[starts[1:] - 1]])[run]
        # the lowest sum so far, in one pass: each thread runs below all threads before it
        shift = run * (2 * size + 2)
        low = np.minimum(np.minimum.accumulate(s - shift), -shift) + shift
        before = np.concatenate([[0], low[:-1]])
        before[starts] = 0
        below = end & (low < before)
        level = s - low - begin  # of the begin, of what an end closes, of what stands in a scope
        under = -low
        under[run == 0] += self.under

        at = np.flatnonzero(begin)
        width = int(level.max(initial=0)) + 2
        place = lambda i, k: (run[i] * width + k) * size + i
        order = at[np.argsort(place(at, level[at]))]
        sorted_places = place(order, level[order])
        enclosing = lambda i, k: order[np.searchsorted(sorted_places, place(i, k)) - 1]
        parent = np.full(size, -1, dtype=np.int64)
        inside = np.flatnonzero(~end & (level > 0))
        parent[inside] = enclosing(inside, level[inside] - 1)
        ends = np.flatnonzero(end & ~below)
        closed = enclosing(ends, level[ends])
        end_of, closes = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        end_of[closed], closes[ends] = ends, closed

        seq, ns = (np.concatenate([np.array([x[k] for x in self.open], np.int64), b.column(c).to_numpy(zero_copy_only=False)]) for k, c in ((1, "seq"), (2, "date_ns")))
        name = b.column("name")
        name = pa.concat_arrays([pa.array([x[0] for x in self.open], name.type), name]) if m else name
        real = slice(m, size)

        def taken(values: np.ndarray, i: np.ndarray) -> pa.Array:
            return pa.array(values[np.maximum(i, 0)], pa.int64(), mask=i < 0)

        out = {c: b.column(c) for c in self.columns}
        out |= {
            "_part": pa.array(np.full(n, self.part, np.int32)), "_under": pa.array(under[real]), "_local": pa.array(level[real].astype(np.int32)),
            "_below": pa.array(below[real]), "_late": pa.array(((closes >= 0) & (closes < m))[real]), "_closes": taken(seq, closes[real]), "_up_ns": taken(ns, parent[real]),
            "_end_seq": taken(seq, end_of[real]), "_end_ns": taken(ns, end_of[real]), "_end_name": name.take(pa.array(end_of[real], mask=end_of[real] < 0)),
            "_effect": pa.nulls(n, self.schema.field("_effect").type),
        }
        if self.paths:
            own = begin.astype(np.int64)
            n_up = np.where(end, 0, level + own)[real]
            offsets = np.concatenate([[0], np.cumsum(n_up)])
            up = np.empty(offsets[-1], dtype=np.int64)
            rest, cur, to = np.flatnonzero(n_up), np.where(begin, np.arange(size), parent)[real], offsets[1:] - 1
            cur, to, left = cur[rest], to[rest], n_up[rest]
            while len(cur):
                up[to] = cur
                go = left > 1
                cur, to, left = parent[cur[go]], to[go] - 1, left[go] - 1
            offsets = pa.array(offsets.astype(np.int32))
            out |= {"_names": pa.ListArray.from_arrays(offsets, name.take(pa.array(up))), "_ids": pa.ListArray.from_arrays(offsets, pa.array(seq[up]))}
        else:
            out |= {c: pa.nulls(n, self.schema.field(c).type) for c in ("_names", "_ids")}
        yield pa.RecordBatch.from_arrays([out[c].cast(self.schema.field(c).type) for c in self.schema.names], schema=self.schema)

        def left_open(r: int) -> list[tuple]:
            i = at[(run[at] == r) & (end_of[at] < 0)]
            return list(zip(name.take(pa.array(i)).to_pylist(), seq[i].tolist(), ns[i].tolist(), strict=True))

        if len(starts) > 1 and self.first:
            self.open, self.under = left_open(0), int(under[starts[1] - 1])
            yield self.effect()
            self.first = False
        self.key, self.open, self.under = key_at(n - 1), left_open(int(run[-1])), int(under[-1])


def _chunks(df: DataFrame, keys: list[str], paths: bool) -> DataFrame:
    """``df`` with what each row does inside its range, and a row for the effect of each range's first and last thread."""
    from pyspark.sql.pandas.types import to_arrow_schema

    on_workers(df.sparkSession)
    fields = [StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields]  # rows of effects have the keys alone
    schema = StructType([*fields, *StructType.fromDDL(_MORE).fields])
    arrow, columns = to_arrow_schema(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Range(keys, arrow, columns, paths)
        for b in batches:
            if b.num_rows:
                yield from r.rows(b)
        if r.key is not None:
            yield r.effect()

    return df.repartitionByRange(*keys, "seq").sortWithinPartitions(*keys, "seq").mapInArrow(run, schema)


def _entries(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _part, _entry)``: the stack on which a range goes on with a thread of the range before it."""
    effects = chunks.where("_effect is not null").select(*keys, "_part", "_under", "_effect")
    schema = StructType([*[chunks.schema[k] for k in keys], *StructType.fromDDL(f"_part int, _entry {_OPEN}").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (k := tuple(r[c] for c in keys)) != key:
                    key, stack = k, []
                if stack:
                    out.append({c: r[c] for c in keys} | {"_part": r["_part"], "_entry": stack})
                stack = stack[: max(0, len(stack) - r["_under"])] + r["_effect"]
            yield pa.RecordBatch.from_pylist(out, arrow)

    return effects.repartition(*keys).sortWithinPartitions(*keys, "_part").mapInArrow(run, schema)


class Stacks:
    """A trace whose stacks were followed once; the tables below are views of it.

    ``rows()`` are all rows with ``orphan`` (an end without a begin), ``depth`` after the row and ``level``; ``located()`` are
    begins and data with ``parent_id``, ``path`` (names from the root) and ``scope_path`` (their ids); ``scopes()`` are begins
    with the end that closes them. ``seq`` is the order of arrival in a thread; keys and ``seq`` are not null, and a ``seq``
    stands once in a thread.
    """

    def __init__(self, df: DataFrame, keys: list[str], paths: bool = True):
        self.keys, self.columns = keys, df.columns
        self._chunks = materialize(_chunks(df, keys, paths), "stacks")
        entries = F.broadcast(_entries(self._chunks, keys))  # at most a row for each range
        d = self._chunks.where("_effect is null").drop("_effect").join(entries, [*keys, "_part"], "left")
        d = d.withColumn("_entry", F.coalesce("_entry", F.array().cast(_OPEN)))
        d = d.withColumn("_keep", F.greatest(F.size("_entry") - F.col("_under"), F.lit(0)).cast("int"))
        d = d.withColumn("orphan", F.col("_below") & (F.col("_under") > F.size("_entry")))
        d = d.withColumn("level", (F.col("_keep") + F.col("_local")).cast("long"))
        self._rows = d.withColumn("depth", F.when(F.col("kind") == "scope_begin", F.col("level") + 1).otherwise(F.col("level")))

    def rows(self) -> DataFrame:
        return self._rows.select(*self.columns, "orphan", "depth", "level")

    def _under(self, of: Column, what: str) -> Column:
        """The nearest enclosing scope's ``what``: the range's own, else the last that is left of its entry."""
        before = F.when(F.col("_keep") > 0, F.get("_entry", F.col("_keep") - 1)[what])
        return F.when(F.col("_local") > 0, of).otherwise(before)

    def located(self, start: bool = False) -> DataFrame:
        """Begins and data; ``start`` adds ``up_ns``, the begin of the enclosing scope."""
        own = F.when(F.col("kind") == "data", F.array("name")).otherwise(F.array().cast("array<string>"))
        old = F.slice("_entry", F.lit(1), F.col("_keep"))
        whole = F.col("_keep") > 0
        d = self._rows.where(F.col("kind").isin("scope_begin", "data"))
        return d.select(
            *self.columns, "orphan", "depth", "level",
            self._under(F.get("_ids", F.col("_local") - 1), "id").alias("parent_id"),
            F.when(whole, F.concat(old["name"], "_names", own)).otherwise(F.concat("_names", own)).alias("path"),
            F.when(whole, F.concat(old["id"], "_ids")).otherwise(F.col("_ids")).alias("scope_path"),
            *([self._under(F.col("_up_ns"), "ns").alias("up_ns")] if start else []),
            "_end_seq", "_end_ns", "_end_name",
        )

    def scopes(self, begins: DataFrame | None = None, close_open: bool = True) -> DataFrame:
        """Begins (``begins``, where they were located already) with ``end_seq``, ``_end``, ``end_name`` and ``is_open``.

        Most ends came in the same batch. The others, some for each batch, are joined to the begins that still wait; where
        none comes the scope is open, and ends at its stream's last date if ``close_open``.
        """
        begins = self._rows.where("kind = 'scope_begin'") if begins is None else begins.where("kind = 'scope_begin'")
        ends = ("_end_seq", "_end_ns", "_end_name")
        kept = [c for c in begins.columns if c not in (*ends, "_entry", "_names", "_ids", "_keep", "_under", "_part")]
        done = begins.where("_end_seq is not null").select(*kept, F.col("_end_seq").alias("end_seq"), F.col("_end_ns").alias("_end"), F.col("_end_name").alias("end_name"), F.lit(False).alias("is_open"))
        entry = F.get("_entry", F.col("_keep"))["id"]
        late = self._rows.where("kind = 'scope_end' and not orphan and (_late or _below)")
        late = late.select(*self.keys, F.when(F.col("_below"), entry).otherwise(F.col("_closes")).alias("_begin"), F.col("seq").alias("end_seq"), F.col("date_ns").alias("_end"), F.col("name").alias("end_name"))
        wait = begins.where("_end_seq is null").select(*kept, F.col("seq").alias("_begin")).join(late, [*self.keys, "_begin"], "left")
        end = F.col("_end")
        if close_open:
            last = self._chunks.where("_effect is null").groupBy("stream_id").agg(F.max("date_ns").alias("_last"))
            wait, end = wait.join(last, "stream_id", "left"), F.coalesce("_end", F.when(F.col("end_seq").isNull(), F.col("_last")))
        return done.unionByName(wait.select(*kept, "end_seq", end.alias("_end"), "end_name", F.col("end_seq").isNull().alias("is_open")))
