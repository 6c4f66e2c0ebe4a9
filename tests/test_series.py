"""Series at several resolutions against plain programs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import series

S = "stream_id long, thread_id long, kind string, path string, time_ns long, seq long, value double"


def farthest(time, value, ns_per_point, block):
    """Indices kept by the extremum-keeping downsample, level after level."""
    keep = np.arange(len(time))
    while len(keep) > block and (time[keep[-1]] - time[keep[0]]) / max(1, len(keep) - 1) < ns_per_point:
        out, last = [], value[keep[0]]
        for s in range(0, len(keep), block):
            part = keep[s : s + block]
            i = part[np.argmax(np.abs(value[part] - last))]
            out.append(i)
            last = value[i]
        keep = np.array(out)
    return keep


def test_exact_downsample_keeps_extremes():
    v = np.zeros(200)
    v[77], v[150] = 100.0, -50.0
    keep = farthest(np.arange(200) * 10, v, 200, 16)
    assert 77 in keep and 150 in keep and len(keep) < 50


@pytest.mark.parametrize("ns,block,chunk,fold", [(300, 4, 1 << 20, 256), (300, 4, 100, 3), (40, 16, 1 << 20, 2), (1, 4, 1 << 20, 2), (10**9, 3, 50, 2)])
def test_exact_downsample_equals_a_plain_program(spark, ns, block, chunk, fold):
    rnd = random.Random(ns)
    rows, want = [], set()
    for path, n in (("long", 1500), ("mid", 90), ("few", 3), ("one", 1)):
        t = np.cumsum([rnd.randrange(0, 30) for _ in range(n)])
        v = np.array([float(rnd.randrange(-50, 50)) for _ in range(n)])  # many ties
        rows += [(0, 1, "data", path, int(a), i, float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))]
        want |= {(path, int(i)) for i in farthest(t, v, ns, block)}
    rnd.shuffle(rows)
    got = series.downsample(spark.createDataFrame(rows, S), ns, "exact", block, chunk, fold).collect()
    assert len(got) == len(want) and {(r.path, r.seq) for r in got} == want
    assert series.downsample(spark.createDataFrame([], S), ns, "exact").count() == 0


def test_exact_downsample_drops_series_that_have_ended_and_passes_over_nulls(spark):
    rnd = random.Random(9)
    rows, want = [], set()
    for path, n, ns in (("dense", 900, 1), ("sparse", 700, 40), ("wide", 60, 10**6), (None, 50, 1)):
        t = np.cumsum([rnd.randrange(ns, 2 * ns + 1) for _ in range(n)])
        v = np.array([float(rnd.randrange(-50, 50)) for _ in range(n)])
        null = set(rnd.sample([i for i in range(n) if i % 4], n // 3))  # no block of nulls only
        rows += [(0, 1, "data", path, int(a), i, None if i in null else float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))]
        if path:
            v[list(null)] = np.nan
            keep = np.arange(n)
            while len(keep) > 4 and (t[keep[-1]] - t[keep[0]]) / (len(keep) - 1) < 200:
                out, last = [], v[keep[0]]
                for s in range(0, len(keep), 4):
                    out.append(keep[s + int(np.nanargmax(np.abs(v[keep[s : s + 4]] - last)))])
                    last = v[out[-1]]
                keep = np.array(out)
            want |= {(path, int(i)) for i in keep}
    got = series.downsample(spark.createDataFrame(rows, S), 200, "exact", 4, 200, 3).collect()
    assert len(got) == len(want) and {(r.path, r.seq) for r in got} == want


def test_blocks_of_nulls_and_after_them_keep_their_first_point(spark):
    rows = [(0, 1, "data", "p", i, i, None if 8 <= i < 12 else float(i % 5)) for i in range(64)]
    got = series.downsample(spark.createDataFrame(rows, S), 3, "exact", 4, 1 << 20, 2).collect()
    assert sorted(r.seq for r in got) == [3, 5, 8, 12, 19, 20, 24, 30, 34, 36, 43, 45, 49, 55, 59, 60]  # as the SQL has it


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_pyramid_shows_every_scope_once(spark, chunk):
    rnd = random.Random(4)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([1, 2, 300])
        rows.append((0, rnd.randrange(2), 0, i, t, t + rnd.choice([0, 1, 50])))
        t = rows[-1][-1]
    df = spark.createDataFrame(rows, "stream_id long, thread_id long, level long, scope_id long, start_ns long, end_ns long")
    p = series.scope_pyramid(df, leaf=2, factor=3, levels=4, chunk=chunk).cache()
    for speck in (0, 1, 49, 50, 299, 10**6):
        got = series.read_pyramid(p, speck).collect()
        assert sum(r.n for r in got) == len(rows)
        assert {r.scope_id for r in got} <= {r[3] for r in rows} and len({r.scope_id for r in got}) == len(got)
        for r in got:
            inside = [x for x in rows if x[1] == r.thread_id and r.start_ns <= x[4] and x[5] <= r.end_ns]
            assert len(inside) >= r.n and (r.res < 0 or r.speck_ns <= speck)
    assert series.read_pyramid(p, 10**6).agg(F.max("res")).first()[0] == 3
    p.unpersist()
