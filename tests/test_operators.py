"""Operators against plain sequential programs on random input, and invariants."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import formats
from spanlake.operators import locks, logs, memory, profile, scopes, select, series
from spanlake.sources import clock, sinks, strings, trace_io

COLS = "stream_id long, thread_id long, seq long, date_ns long, kind string, name string, v_double double"


def random_trace(seed, n=400, threads=3):
    rnd = random.Random(seed)
    return [
        (rnd.randrange(2), rnd.randrange(threads), i, i * 10 + rnd.randrange(10), rnd.choice(["scope_begin", "scope_begin", "scope_end", "scope_end", "data"]), rnd.choice(["a", "b", "c", ""]), rnd.random())
        for i in range(n)
    ]


def stacks(rows):
    """Scopes and orphan ends by a stack for each thread."""
    out, orphans, open_ = {}, set(), {}
    for s, t, seq, date, kind, name, _ in rows:
        st = open_.setdefault((s, t), [])
        if kind == "scope_begin":
            st.append(seq)
            out[seq] = [len(st) - 1, date, None, [x for x in st]]
        elif kind == "scope_end":
            if st:
                out[st.pop()][2] = date
            else:
                orphans.add(seq)
    return out, orphans


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairing_equals_a_stack(spark, seed):
    rows = random_trace(seed)
    df = spark.createDataFrame(rows, COLS)
    want, orphans = stacks(rows)
    assert {r.seq for r in scopes.depths(df).where("orphan").collect()} == orphans
    got = {r.scope_id: r for r in scopes.scopes_with_paths(df).collect()}
    assert set(got) == set(want)
    last = {s: max(r[3] for r in rows if r[0] == s) for s in (0, 1)}
    names = {r[2]: r[5] for r in rows}
    for k, (level, start, end, path) in want.items():
        r = got[k]
        assert (r.level, r.start_ns, r.is_open) == (level, start, end is None)
        assert r.end_ns == (end if end is not None else last[r.stream_id])
        assert list(r.scope_path) == path and list(r.path) == [names[x] for x in path]


def test_self_times_sum_to_roots(spark):
    df = spark.createDataFrame([r for r in random_trace(5) if r[4] != "data"], COLS)
    p = profile.profile(scopes.scopes_with_paths(df))
    total = p.agg(F.sum("self").alias("s"), F.sum(F.when(F.col("depth") == 0, F.col("value"))).alias("r")).first()
    assert total.s == total.r
    flame = profile.flame_layout(p)
    assert flame.where("x < 0").count() == 0


def test_clock_repairs(spark):
    rnd = random.Random(3)
    full, t = [], 0
    for _ in range(300):
        t += rnd.randrange(1, 3 << 29)
        full.append(t)
    df = spark.createDataFrame([(0, 0, i, v % (1 << 32), v) for i, v in enumerate(full)], "stream_id long, thread_id long, seq long, tick long, want long")
    assert clock.unwrap_counter(df, "tick").where("tick_full <> want").count() == 0
    dates = [rnd.randrange(100) for _ in range(200)]
    want, last = [], 0
    for x in dates:
        last = x if x > last else last + 1
        want.append(last)
    df = spark.createDataFrame([(0, 0, i, x, w) for i, (x, w) in enumerate(zip(dates, want, strict=True))], "stream_id long, thread_id long, seq long, date_ns long, want long")
    assert clock.monotonic_dates(df).where("fixed_ns <> want").count() == 0
    ref = spark.createDataFrame([(0, 7, (5 << 32) + (1 << 32) - 10)], "stream_id long, buffer_id long, tick long")
    d = spark.createDataFrame([(0, 7, 4), (0, 7, (1 << 32) - 5)], "stream_id long, buffer_id long, low long")
    assert {r.low_full for r in clock.resync_counter(d, ref, "low").collect()} == {(6 << 32) + 4, (5 << 32) + (1 << 32) - 5}


def test_pointer_matching_equals_a_map(spark):
    rnd = random.Random(4)
    rows = [(0, rnd.randrange(3), i, i * 5, rnd.randrange(6), rnd.choice(["alloc", "dealloc"]), 8) for i in range(300)]
    live, want = {}, {}
    for _, th, seq, _, ptr, kind, _ in rows:
        if kind == "alloc":
            live[ptr] = seq
            want[seq] = None
        elif ptr in live:
            want[live.pop(ptr)] = seq
    df = spark.createDataFrame(rows, "stream_id long, thread_id long, seq long, date_ns long, ptr long, kind string, size long")
    a = memory.allocations(df)
    assert {r.alloc_seq: r.free_seq for r in a.collect()} == want
    assert memory.memory_curve(a).where("bytes < 0").count() == 0


def test_wait_closing_equals_a_flag(spark):
    rnd = random.Random(6)
    kinds = ["lock_wait_begin", "lock_acquired", "lock_released", "lock_notified"]
    rows = [(f"l{rnd.randrange(3)}", 0, rnd.randrange(3), i, i * 10, rnd.choice(kinds)) for i in range(300)]
    waiting, want = {}, set()
    for _, _, th, seq, _, kind in rows:
        if kind == "lock_wait_begin":
            waiting[th] = seq
        elif kind != "lock_notified" and th in waiting:
            want.add((waiting.pop(th), seq))
    df = spark.createDataFrame(rows, "name string, stream_id long, thread_id long, seq long, date_ns long, kind string")
    assert {(r._seq, r.seq) for r in locks.wait_ends(df).collect()} == want


def test_histogram_counts_all(spark):
    df = spark.createDataFrame([(0, 0, "s", "p", i, i, float(i % 37)) for i in range(500)], "stream_id long, thread_id long, kind string, path string, time_ns long, seq long, value double")
    h = series.histogram(df, bins=10)
    assert h.agg(F.sum("n")).first()[0] == 500
    assert series.cumulative(h).agg(F.max("upto")).first()[0] == 500
    one = series.histogram(df.withColumn("value", F.lit(3.0)), bins=10)
    assert [(r.bin, r.n) for r in one.collect()] == [(0, 500)]


def test_patterns():
    import re

    def ok(pattern, path):
        rx = select.pattern_regex(pattern)
        rx = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m.group(1)), rx)
        return re.match(rx, select.SEP.join(path.split("/"))) is not None

    assert ok("b", "a/b") and not ok("a", "a/b") and ok(".a/b", "a/b") and not ok(".b", "a/b")
    assert ok("a/*/c", "x/a/b/c") and not ok("a/*/c", "a/c") and ok("a/**/c", "a/c") and ok("a/**/c", "a/x/y/c")
    assert ok("**", "a/b") and ok("a/**", "a/b/c") and ok("./a", "a")


def test_printf():
    p = logs.printf
    assert p("n=%03d v=%.2f", [7, 1.005]) == "n=007 v=1.00"
    assert p("%-6d|%g %% %s", [5, 0.5, "x"]) == "5     |0.5 % x"
    assert p("%X %b %d", [255, 5]) == "FF 101 %d"
    assert p("%q", [1]) == "%q"
    assert p("%a %A %.2a %8a|", [1.0, 0.5, 3.14159, -2.0]) == "0x1p+0 0X1P-1 0x1.92p+1  -0x1p+1|"


def test_fnv_and_decoding(spark):
    assert f"{int(strings.fnv1a(['a'])[0]):016X}" == "AF63DC4C8601EC8C"
    assert int(strings.fnv1a(["foobar"], 32)[0]) == 0xBF9CF968
    d = spark.createDataFrame([("00000000000000AB", "hello")], "hash string, value string")
    t = spark.createDataFrame([(1, "x @@00000000000000AB@@ y @@00000000000000CD@@"), (2, "none"), (3, ""), (4, None), (5, "\1 @@00000000000000AB@@\2")], "k long, line string")
    want = {1: "x hello y 00000000000000CD", 2: "none", 3: "", 4: None, 5: "\1 hello\2"}
    assert {r.k: r.decoded for r in strings.decode_text(t, "line", d, "k").collect()} == want


def test_lookup_file(spark, tmp_path):
    (tmp_path / "f").write_text("@@00000000000000ab@@zz\n@@00000000000000AB@@aa\nno line\n@@00000000000000CD@@\n@@00000000000000xy@@bad\n")
    got = {r.hash: r.value for r in strings.read_dictionary(spark, str(tmp_path / "f"), salt=2).collect()}
    assert got == {"00000000000000AB": "zz", "00000000000000CD": "", f"{14695981039346656037 + 2:016X}": "", f"{2166136261 + 2:016X}": ""}
    df = spark.createDataFrame([("00000000000000ab",), ("00000000000000AB",), ("00000000000000EF",), (None,)], "hash string")
    d = spark.createDataFrame(list(got.items()), "hash string, value string")
    assert sorted(str(r.text) for r in strings.resolve_strings(df, d).collect()) == ["@@00000000000000EF@@", "None", "zz", "zz"]


@pytest.mark.parametrize("chunk", [1 << 20, 7, 1])
def test_running_values_equal_a_loop(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(rnd.randrange(3), i, rnd.choice([None, *range(-5, 9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, seq long, v int")
    from spanlake.operators.scan import running

    how = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.col("v"))}
    for before in (False, True):
        for back in (False, True):
            got = {r.seq: (r.s, r.hi, r.lo, r.l) for r in running(df, ["k"], {n: (*v, "before " * before + "back" * back) for n, v in how.items()}, chunk).collect()}
            for k, i, _ in rows:
                seen = [x for a, j, x in rows if a == k and x is not None and ((j < i or (j == i and not before)) if not back else (j > i or (j == i and not before)))]
                last = (seen[0] if back else seen[-1]) if seen else None
                assert got[i] == ((sum(seen), max(seen), min(seen), last) if seen else (None,) * 4)


@pytest.mark.parametrize("chunk", [1 << 20, 5])
def test_clocks_and_locks_of_one_hot_key(spark, chunk):
    """All rows stand under one key, and chunks spread it."""
    rnd = random.Random(3)
    rows = [(0, 0, i, max(0, i * 10 + rnd.randrange(-40, 40)), rnd.choice(["lock_acquired", "lock_released", "lock_wait_begin"]), "L", 0.0) for i in range(150)]
    df = spark.createDataFrame(rows, COLS)
    last, clamp, want = 0, 0, {}
    for _, _, i, t, *_ in rows:
        last, clamp = t if t > last else last + 1, max(clamp, t)
        want[i] = (last, clamp)
    mono = {r.seq: r.fixed_ns for r in clock.monotonic_dates(df, chunk=chunk).collect()}
    low = {r.seq: r.fixed_ns for r in clock.clamp_dates(df, chunk).collect()}
    assert {i: (mono[i], low[i]) for i in mono} == want
    ticks, full = [], 0
    for i in range(150):
        full += rnd.randrange(0, 150)
        ticks.append((0, 0, i, full % 256, full))
    t = spark.createDataFrame(ticks, "stream_id long, thread_id long, seq long, tick long, full long")
    assert clock.unwrap_counter(t, "tick", 8, chunk=chunk).where("tick_full <> full").count() == 0
    held, uses = None, []
    for _, _, i, t, kind, *_ in rows:
        if kind == "lock_acquired" and held is None:
            held = (i, t)
        elif kind == "lock_released" and held is not None:
            uses.append((*held, t))
            held = None
    uses += [(*held, None)] if held else []
    assert sorted((r.seq, r.start_ns, r.end_ns) for r in locks.lock_uses(df, chunk).collect()) == uses


def test_unresolved_reasons(spark):
    rows = [(0, 1, 0, 0, "scope_begin", "a", None), (0, 1, 1, 1, "scope_begin", "b", None), (0, 1, 2, 2, "data", "x", 1.0), (0, 1, 3, 3, "scope_end", "", None), (0, 1, 4, 4, "scope_end", "", None), (0, 2, 5, 5, "scope_begin", "c", None), (0, 2, 6, 6, "data", "y", 1.0)]
    df = scopes.with_paths(spark.createDataFrame(rows, COLS))
    threads = spark.createDataFrame([(0, 1, "one"), (0, 2, "two")], "stream_id long, thread_id long, name string")
    spec = select.EventSpec
    specs = [spec(("x",), "nobody"), spec(("zz",)), spec(("c/x",)), spec(("./b/x",)), spec(("x",), parent="q"), spec(("x",), parent="q/b"), spec(("x",), parent="./b"), spec(("y",), parent="a"), spec(("b/x",), "one", "a"), spec(("y",), "one")]
    got = {r.spec_id: r.reason for r in select.explain_unresolved(df, specs, threads).collect()}
    assert got == dict(enumerate(["unknown thread", "unknown event name", "event path not found", "not at the event's root", "unknown parent name", "parent path not found", "not at the parent's root", "parents differ", "resolved", "unknown event name"]))
    assert {r.reason for r in select.explain_unresolved(df.limit(0), specs, threads).collect()} == {"no events"}


def test_import_of_streams_with_other_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "seq long, name string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, 3)], "seq long, extra long").write.parquet(str(tmp_path / "b"))
    got = trace_io.import_streams(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("stream_id").collect()
    assert [(r.stream_id, r.seq, r.name, r.extra) for r in got] == [(0, 1, "a", None), (1, 2, None, 3)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame(random_trace(9, 60), COLS)
    sinks.export_ctf(df, str(tmp_path / "ctf"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "ctf")).collect()]
    assert lines and all(x["ph"] in "BE" for x in lines)
    sinks.export_text(df, str(tmp_path / "txt"), n=10)
    assert spark.read.text(str(tmp_path / "txt")).count() <= 10
    trace_io.write_trace(df, str(tmp_path / "trace"))
    back = trace_io.read_trace(spark, str(tmp_path / "trace"), streams=[1])
    assert back.count() == df.where("stream_id = 1").count()
    files = list((tmp_path / "trace" / "events").rglob("*.parquet"))
    size = sinks.stored_size(spark, str(tmp_path / "trace"))
    assert tuple(size.first()) == (len(files), sum(f.stat().st_size for f in files))
    told = sinks.trace_summary(df, size).collect()
    assert {r.bytes for r in told} == {size.first().bytes} and max(r.share_bytes for r in told) == size.first().bytes
    spark.range(1).selectExpr("99 as version").write.mode("overwrite").parquet(str(tmp_path / "trace" / "meta"))
    with pytest.raises(ValueError):
        trace_io.read_trace(spark, str(tmp_path / "trace"))


def test_formats(spark):
    r = spark.range(1).select(
        formats.fmt_duration(F.lit(1_500_000)).alias("a"), formats.fmt_bytes(F.lit(999)).alias("b"), formats.fmt_grouped(F.lit(1234567)).alias("c"), formats.fmt_time(F.lit(3_661_000_002_003)).alias("d")
    ).first()
    assert (r.a, r.b, r.c, r.d) == ("1.50 ms", "999 B", "1 234 567", "01:01:01.000_002_003")
