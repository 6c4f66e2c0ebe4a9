"""Line dedup against a plain program; the perfect hash and the shards by themselves."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanlake.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owners = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                owners.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    a[:50], b[50:60] = a[0], b[0]  # one word may be equal
    h, end = lines.PerfectHash.unpack((raw := lines.PerfectHash.build(a, b).pack()) + b"more")
    assert end == len(raw) and sorted(h.places(a, b)) == list(range(5000))
    s = lines.Shard(lines.Shard.pack(a, b, np.arange(5000) + 1, np.arange(5000) * 7))
    p = s.hash.places(a, b)
    assert (s.count[p] == np.arange(5000) + 1).all() and (s.first[p] == np.arange(5000) * 7).all()
    others = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    assert not s.drops(*others, np.full(5000, 10**9)).any()


def test_lines_against_a_plain_program(spark):
    rnd = random.Random(3)
    hot, words = "THE line that very many documents hold", [f"Line number {i} of the pool" for i in range(60)]
    rows = []
    for i in range(300):
        ls = [rnd.choice([" ", "", "\t"]) + rnd.choice(words).swapcase() + rnd.choice(["", "\r", "  "]) if rnd.random() < 0.5 else f"own {i} {rnd.random()}" for _ in range(rnd.randint(0, 6))]
        if i % 3 == 0:
            ls += [hot, hot.upper() + "\x0b"]
        rows.append((i * 5 % 301, "\n".join(ls)))
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "éééééééééé"), (404, " ÉÉÉÉÉÉÉÉÉÉ"), (405, "éééééééééé "), (406, "éééééééééé"), (407, "short one"), (408, "Short One"), (409, hot + "\n" + "long text " * 200_000)]
    rows += [(None, hot), (None, hot), (403, "éééééééééé\nother words here"), rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert told(lines.dedup_lines(d)) == want
    # small shards, and several copies of each
    clash = d.withColumns({c: F.lit("own") for c in ("doc", "a", "b", "shard", "copy", "lost", "n", "first", "key", "arrays", "kept", "n_lines")})
    assert told(lines.dedup_lines(clash, shard_keys=8, probes=5)) == want
    assert lines.dedup_lines(d.limit(0)).count() == 0
    assert told(lines.dedup_lines(d.limit(1))) == plain(rows[:1])
