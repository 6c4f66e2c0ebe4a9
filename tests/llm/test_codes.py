"""Product codes against a plain program; cover trees by themselves."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import codes


def plain(rows, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    kept = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1]) if kept else 4
    cut = [(p * d // 4, (p + 1) * d // 4) for p in range(4)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in cut]

    def nearest(book, w):
        return min((sum((x - y) ** 2 for x, y in zip(w, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for (a, b), book in zip(cut, books, strict=True):
            got = {}
            for _, v, _ in kept:
                got.setdefault(nearest(book, v[a:b])[1], []).append(v[a:b])
            for e, ws in got.items():
                book[e] = [sum(c) // len(ws) for c in zip(*ws, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        best = [nearest(book, v[a:b]) for (a, b), book in zip(cut, books, strict=True)]
        error = sum(x for x, _ in best)
        out.append([i, "".join(f"{e:02x}" for _, e in best), error, label])
        by_label[label] = by_label.get(label, 0) + error
    h = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], h) for i, c, e, label in out), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("points", [
    np.random.default_rng(1).integers(-2000, 2000, (700, 16)),
    np.random.default_rng(2).integers(-3, 3, (400, 3)),
    np.zeros((300, 4), dtype=np.int64),
    np.repeat(np.random.default_rng(3).integers(-5000, 5000, (12, 8)), 50, axis=0) + np.random.default_rng(4).integers(-3, 4, (600, 8)),
    np.random.default_rng(5).integers(-(1 << 26) + 1, 1 << 26, (60, 16)),
])
def test_cover_trees_cover_and_assign_exactly(points):
    t = codes.CoverTree.unpack(codes.CoverTree.build(points).pack())
    assert sorted(t.order) == list(range(len(points))) and (t.points == points[t.order]).all()
    for k in range(len(t.lo)):
        run = t.points[t.lo[k] : t.hi[k]]
        assert ((run - run[0]) ** 2).sum(axis=1).max() == t.r2[k]
        if t.kid0[k] < t.kid1[k]:
            kids = range(t.kid0[k], t.kid1[k])
            assert t.lo[kids[0]] == t.lo[k] and t.hi[kids[-1]] == t.hi[k] and all(t.hi[a] == t.lo[a + 1] for a in kids[:-1])
            level = next(n for n in range(99) if 4**n >= t.r2[k])
            heads = t.points[t.lo[list(kids)]]
            apart = ((heads[:, None] - heads[None]) ** 2).sum(axis=2) + np.eye(len(heads), dtype=np.int64) * (1 << 62)
            assert 4 * apart.min() > 4**level and all(4 * t.r2[c] <= 4**level for c in kids)
    book = points[:: max(1, len(points) // 40)].copy()
    book[-1] = book[0]  # a tie of entries
    got = np.full(len(points), -1)
    runs, compared = t.assign(book)
    for lo, hi, e in runs:
        for a, b, x in zip(lo, hi, e, strict=True):
            assert (got[a:b] == -1).all()
            got[a:b] = x
    assert (got == ((t.points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    if len(np.unique(points, axis=0)) < len(points) // 2:
        assert compared < len(points)  # whole runs went by the triangle inequality


def test_codes_against_a_plain_program(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 0.2, (30, 8))
    rows = [(int(i), [float(np.float32(x)) for x in base[rng.integers(30)] + rng.normal(0, 0.05, 8)], int(rng.integers(4))) for i in rng.permutation(420)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]  # one vector many times
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 8, 1), (2003, [float("nan")] + [0.0] * 7, None), (2004, [float("inf")] + [0.0] * 7, 2), (2005, [0.5] * 4, 2)]
    rows += [(2006, [-0.0001] * 8, None), (2007, [0.5] * 8, None), (None, [0.25] * 8, 3), (5, rows[3][1], 2), (5, rows[4][1], 2), rows[1]]
    want = plain(rows)
    d = table(spark, rows).repartition(5)
    assert told(codes.compress(d)) == want
    clash = d.withColumns({c: F.lit("own") for c in ("id", "v", "code", "error", "salt", "known", "name", "cell", "ids", "trees", "label_error")})
    assert told(codes.compress(clash, block=50)) == want
    assert told(codes.compress(d, entries=5, rounds=2)) == plain(rows, 5, 2)
    assert codes.compress(d.limit(0)).count() == 0
    few = [(3, [0.1, 0.2, 0.3, 0.4, 0.5], None), (9, [0.9, 0.2, 0.1, 0.4, 0.5], None), (4, [0.1], 7)]
    assert told(codes.compress(table(spark, few))) == plain(few)


def test_components_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="component"):
        codes.compress(table(spark, [(1, [70000.0] * 4, 0)])).count()
