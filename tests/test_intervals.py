"""Joins by aligned blocks, scans of large keys and snapshots, against plain programs."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import cpu, locks, memory, scopes
from spanlake.operators.intervals import contained
from spanlake.operators.scan import running


@pytest.mark.parametrize("bucket", [1, 7, 1000, 10**9])
def test_containment_equals_all_pairs(spark, bucket):
    rnd = random.Random(bucket)
    iv = [(rnd.randrange(3), i, a := rnd.randrange(-5000, 5000), a + rnd.choice([0, 1, 10, 3000, -4])) for i in range(120)] + [(0, 900, -5000, 5000), (0, 901, 5, None), (1, 902, 7, 7)]
    pt = [(rnd.randrange(4), rnd.randrange(-6000, 6000)) for _ in range(150)] + [(1, 7), (1, 7)]
    a, b = spark.createDataFrame(iv, "k long, id long, lo long, hi long"), spark.createDataFrame(pt, "k long, at long")
    got = sorted((r.k, r["at"], r.id) for r in contained(a, b, ["k"], "lo", "hi", "at", bucket).collect())
    assert got == sorted((k, t, i) for k, t in pt for x, i, lo, hi in iv if x == k and hi is not None and lo <= t <= hi)
    assert contained(a.limit(0), b, ["k"], "lo", "hi", "at", bucket).count() == 0


def test_an_interval_over_everything_is_few_rows(spark):
    df = spark.createDataFrame([(0, 1, 10**18 - 5), (0, 12345, 12345)], "k long, lo long, hi long")
    p = spark.createDataFrame([(0, 99)], "k long, at long")
    j = contained(df, p, ["k"], "lo", "hi", "at", 1)
    assert j.count() == 1
    dealt = df.where("lo = 1").selectExpr("1L as _lo", "hi + 1 as _hi", "55 as _top")
    from spanlake.operators.intervals import _blocks

    blocks = [r.x for r in dealt.select(F.explode(F.expr(_blocks("_lo", "_hi"))).alias("x")).collect()]
    assert sum(2**x.k for x in blocks) == 10**18 - 5 and len(blocks) < 150


@pytest.mark.parametrize("chunk", [1 << 20, 11])
def test_scans_equal_loops(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(1, 4), rnd.randrange(10**6) * 1000 + i, rnd.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    out = running(df, ["k"], {"s": ("sum", F.col("v")), "p": ("last", F.col("v"), "before"), "n": ("last", F.col("v"), "before back"), "m": ("min", F.col("v"), "back"), "g": ("max", F.col("v"))}, chunk, ("t",))
    got = {(r.k, r.t): (r.s, r.p, r.n, r.m, r.g) for r in out.collect()}
    for k in range(4):
        mine = sorted(r for r in rows if r[0] == k)
        vs = [r[2] for r in mine]
        known = lambda x: [v for v in x if v is not None]
        for i, (_, t, _) in enumerate(mine):
            upto, after = known(vs[: i + 1]), known(vs[i + 1 :])
            assert got[k, t] == (sum(upto) if upto else None, (known(vs[:i]) or [None])[-1], (after or [None])[0], min(known(vs[i:]), default=None), max(upto, default=None))


def test_operators_on_large_keys_equal_those_on_small(spark):
    rnd = random.Random(3)
    kinds = ["lock_wait_begin", "lock_acquired", "lock_released", "lock_notified"]
    df = spark.createDataFrame([(f"l{rnd.randrange(2)}", 0, rnd.randrange(3), i, i * 10, rnd.choice(kinds)) for i in range(300)], "name string, stream_id long, thread_id long, seq long, date_ns long, kind string")
    sw = spark.createDataFrame([(0, i, rnd.randrange(200), rnd.randrange(2), rnd.randrange(-2, 3)) for i in range(300)], "stream_id long, seq long, date_ns long, core int, runner long")
    mem = spark.createDataFrame([(0, rnd.randrange(2), i, i * 5, rnd.randrange(9), rnd.choice(["alloc", "dealloc"]), 8) for i in range(300)], "stream_id long, thread_id long, seq long, date_ns long, ptr long, kind string, size long")
    tr = spark.createDataFrame([(0, rnd.randrange(2), i, i * 5, rnd.choice(["scope_begin", "scope_end"]), "x") for i in range(300)], "stream_id long, thread_id long, seq long, date_ns long, kind string, name string")
    sc, al = scopes.pair_scopes(tr), memory.allocations(mem)
    dates = spark.createDataFrame([(0, rnd.randrange(2), rnd.randrange(-50, 1600)) for _ in range(60)], "stream_id long, thread_id long, at_ns long")
    told = lambda x: sorted(str(r) for r in x.collect())
    for f in (
        lambda c: locks.lock_uses(df, c), lambda c: locks.wait_ends(df, c), lambda c: locks.wakeup_latency(df, c), lambda c: cpu.core_intervals(sw, c), lambda c: cpu.cpu_curve(sw, c),
        lambda c: cpu.thread_run_intervals(sw, c), lambda c: memory.memory_curve(al, c), lambda c: memory.scope_memory(sc, al, c), lambda c: scopes.locate(sc, dates, 64, c),
    ):
        assert told(f(20)) == told(f(1 << 20))


def test_snapshots_equal_live_allocations(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.randrange(3), rnd.randrange(2), i, i * 7, rnd.randrange(12), rnd.choice(["alloc", "alloc", "dealloc"]), i) for i in range(400)]
    a = memory.allocations(spark.createDataFrame(rows, "stream_id long, thread_id long, seq long, date_ns long, ptr long, kind string, size long"))
    memory.write_snapshots(a, str(tmp_path / "s"), 250)
    for at in (0, 1, 249, 250, 1234, 2799, 10**6):
        got = memory.live_in(spark, str(tmp_path / "s"), at)
        want = memory.live_at(a, spark.createDataFrame([(s, at) for s in range(3)], "stream_id long, at_ns long"), 100)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    plan = memory.live_in(spark, str(tmp_path / "s"), 1234)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan.split("== Physical Plan ==")[1]
    assert memory.live_in(spark, str(tmp_path / "s"), -5).count() == 0
