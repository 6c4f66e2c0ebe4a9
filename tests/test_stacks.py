"""Stacks in ranges against a plain program: hot threads, small batches, deep nesting, dates that go back."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import scopes
from spanlake.operators.stacks import Stacks

COLS = "stream_id long, thread_id long, seq long, date_ns long, kind string, name string, v_double double, note string"
KINDS = ["scope_begin"] * 5 + ["scope_end"] * 5 + ["data"] * 3 + ["lock_acquired"]


def trace(seed, n=900):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        thread = 7 if rnd.random() < 0.5 else rnd.randrange(5)  # one thread has half of all rows
        rows.append((rnd.randrange(2) if thread != 7 else 0, thread, i, rnd.randrange(10_000), rnd.choice(KINDS), rnd.choice(["a", "b", "c", "", None]), rnd.random(), f"n{i}"))
    rows += [(0, 9, 2000 + i, i, "scope_begin", f"r{i % 3}", None, None) for i in range(150)] + [(0, 9, 2150, 0, "data", "d", 1.0, None)]
    rows += [(0, 9, 2200 + i, i, "scope_end", "", None, None) for i in range(90)] + [(0, 9, 2300, 0, "data", "e", 1.0, None), (1, 11, 5, 5, "scope_end", "x", None, None), (1, 12, 6, 6, "data", "x", 2.0, None)]
    return rows


def plain(rows):
    """By ``(stream, thread, seq)``: level, depth, orphan, parent, path, ids and, for begins, the end."""
    out, stacks = {}, {}
    for s, t, seq, date, kind, name, *_ in sorted(rows, key=lambda r: r[2]):
        st = stacks.setdefault((s, t), [])
        row = {"orphan": False, "up_ns": st[-1][2] if st else None, "parent": st[-1][0] if st else None, "end": None}
        if kind == "scope_begin":
            st.append((seq, name, date))
            row["level"] = len(st) - 1
        elif kind == "scope_end":
            row["orphan"] = not st
            if st:
                out[s, t, st.pop()[0]]["end"] = (seq, date, name)
            row["level"] = len(st)
        else:
            row["level"] = len(st)
        row |= {"depth": len(st), "path": [x[1] for x in st] + [name] * (kind == "data"), "ids": [x[0] for x in st], "kind": kind}
        out[s, t, seq] = row
    return out


@pytest.mark.parametrize("seed,partitions,batch", [(1, 1, 10_000), (2, 9, 10_000), (3, 5, 7), (4, 40, 3)])
def test_stacks_equal_a_plain_program(spark, seed, partitions, batch):
    rows = trace(seed)
    want = plain(rows)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, COLS).withColumn("kept", F.lit(1))  # not nullable
        key = lambda r: (r.stream_id, r.thread_id, r.seq)
        st = Stacks(df, scopes.KEYS)
        got = {key(r): (r.orphan, r.depth, r.level) for r in st.rows().collect()}
        assert got == {k: (w["orphan"], 0 if w["orphan"] else w["depth"], w["level"]) for k, w in want.items()}
        located = scopes.with_paths(df).collect()
        assert {key(r): (r.level, r.parent_id, r.path, r.scope_path, r.note) for r in located} == {
            k: (w["level"], w["parent"], w["path"], w["ids"], f"n{k[2]}" if k[2] < 900 and k[1] < 9 else None) for k, w in want.items() if w["kind"] in ("scope_begin", "data")
        }
        s, data = scopes.scopes_and_data(df)
        last = {x: max(r[3] for r in rows if r[0] == x) for x in (0, 1)}
        began = {r[:3]: r[3] for r in rows}
        told = {(r.stream_id, r.thread_id, r.scope_id): (r.level, r.end_seq, r.end_ns, r.duration_ns, r.end_name, r.is_open, r.path, r.parent_id) for r in s.collect()}
        for k, w in want.items():
            if w["kind"] == "scope_begin":
                end = w["end"] or (None, last[k[0]], None)
                assert told.pop(k) == (w["level"], end[0], end[1], end[1] - began[k], end[2], w["end"] is None, w["path"], w["parent"])
        assert not told
        assert {key(r): (r.parent_id, r.time_ns) for r in data.collect()} == {k: (w["parent"], w["up_ns"]) for k, w in want.items() if w["kind"] == "data"}
        assert scopes.pair_scopes(df).count() == s.count() and scopes.with_paths(df.limit(0)).count() == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
