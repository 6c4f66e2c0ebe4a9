"""Fingerprints, decontamination, near duplicates and repeats against brute force."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, fingerprint, near, repeats
from spanlake.llm.common import connected_components

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"h1": F.lit("x"), "sid": F.lit(1), "k": F.lit(2), "th": F.lit(3), "_once": F.lit(4), "n": F.lit(None).cast("int")})


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()) if not t.isascii() else t.lower()
    return re.sub(r"\s+", " ", t).strip(" ")


TEXTS = ["Ａbc  Def", "abc def", "", None, "x", "Straße STRASSE", "strasse strasse", "été", "ÉTÉ", " a b\tc ", "word " * 500, "ﬁne ①", "same text here", "same text here"]


def test_fingerprints(spark):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in fingerprint.edited_likeness(docs(spark, rows)).collect()}
    for i, t in rows:
        t, nx = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nx[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for f, x in ((r.fingerprint, t), (r.edited_fingerprint, e)):
            assert f[:16] == f"{xxhash.xxh64(canonical(x).encode(), seed=42).intdigest():016X}" and len(f) == 32
        assert r.near_edited == float(canonical(e) == canonical(t)) and r.near_next == float(canonical(nx) == canonical(t))
    sizes = {r.doc_id: r.copies for r in fingerprint.fingerprints(docs(spark, rows)).collect()}
    assert sizes[0] == 2 and sizes[12] == 2 and sizes[5] == 2 and sizes[7] == 2 and sizes[10] == 1


def test_fingerprints_of_odd_tables(spark):
    assert fingerprint.edited_likeness(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprint.edited_likeness(docs(spark, [(1, "only one here")])).collect()
    assert one[0].near_next == 1.0
    rep = fingerprint.edited_likeness(docs(spark, [(1, "aaaa"), (1, "bbbb"), (None, "cccc"), (2, "dddd"), (1, "aaaa")]))
    assert rep.count() == 5 and rep.where("doc_id = 2").first().edited_sha256 == hashlib.sha256(b"dddc").hexdigest()


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def leaks(text, items, k=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(k, len(v))
        wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
        for a in range(len(w) - n + 1):
            if n and tuple(w[a : a + n]) in wins:
                hit |= set(range(a, a + n))
                found.add(str(i))
    return len(w), len(hit), found, hit


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(2)
    vocab = ["alpha", "Beta", "gamma", "é", "x1", "the", "of"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "..."), (None, "null item id words")]
    rows = []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 120))]
        if i % 3 == 0 and w:
            w[len(w) // 2 : len(w) // 2] = items[i % 12][1].split()
        rows.append((i, (", ".join if i % 2 else " ".join)(w)))
    rows += [(60, None), (61, ""), (62, "null item id words"), (5, rows[5][1])]
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else i, t) for i, t in items]
    for block in (1 << 20, 300):
        h, names = decontaminate.with_hits(d.select("doc_id", "text"), b, block_bytes=block)
        for r in h.withColumnsRenamed(dict(zip(names, ("_words", "_spans", "_items"), strict=True))).collect():
            n, _, found, hit = leaks(r.text, named)
            got = {p for s, e in zip(r._spans[::2], r._spans[1::2], strict=True) for p in range(s, e)}
            assert (r._words, got, set(r._items)) == (n, hit, found)
    for r in decontaminate.contamination(d, b).collect():
        text = dict(rows)[r.doc_id]
        n, k, found, _ = leaks(text, named)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, k, len(found), k > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, empty).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_decontaminated_text(spark):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "Nothing here, to see; " * 5
    rows = [(1, f"Before. {item.upper()}! After " + "filler words follow " * 8), (2, clean), (3, item), (4, None)]
    d = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long"))
    out = {r.doc_id: r for r in decontaminate.decontaminate(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4} and out[2].text == clean and out[1].text.startswith("Before. ! After filler") and out[1].n_chars == len(out[1].text)


def components(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(x) for x in range(n)]


def test_connected_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 300)] + [(7, 7)]
    want = components(301, pairs)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()
    assert {r.node: r.component for r in got} == {x: want[x] for e in pairs for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near, "SET_BLOCK", 5)
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(20, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12 if i < 90 else 0])
        for _ in range(rnd.randrange(0, 3)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(150, ""), (151, None), (152, " \n "), (153, "too short"), (154, "Too  SHORT"), (155, "a b c d e"), (3, rows[3][1]), (None, rows[4][1]), (156, "long " * 3000)]
    got = near.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = [set(near.ngram_set(t or "").tolist()) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    rank = {i: k for k, i in enumerate(order)}
    comp = components(len(rows), [(rank[a], rank[b]) for a, b in pairs])
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    want = sorted(str((rows[i][0], rows[order[comp[rank[i]]]][0], links[i])) for i in range(len(rows)))
    assert sorted(str((r.doc_id, r.class_id, r.links)) for r in got) == want
    kept = near.drop_near_duplicates(docs(spark, rows))
    assert kept.count() == len(set(comp)) and "_once" in kept.columns
    assert near.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_band_choice():
    for t in (0.5, 0.7, 0.8, 0.9):
        b, r = near.choose_bands(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99 and b * r <= near.MAX_HASHES


def removed(rows, k):
    """Brute force over all strings of k bytes."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - k + 1):
            w = b[s : s + k]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for s in range(len(b) - k + 1):
            if least[b[s : s + k]] < i:
                m[s : s + k] = True
        out.append((i, len(b), int(m.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "of", "thé", "ab", "a", "zebra", "\x00"])
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rnd.randrange(1, 40)))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            parts += [p[rnd.randrange(20) :], " ".join(word() for _ in range(9))]
        rows.append((i, "|".join(parts)))
    rows += [(80, "a" * 300), (81, "a" * 120 + "b" * 60), (82, None), (83, ""), (84, rows[0][1]), (85, passages[0] * 20), (86, "short")]
    rnd.shuffle(rows)
    got = repeats.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(removed(rows, 50))
    small = repeats.remove_repeats(docs(spark, rows), min_len=12).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in small) == sorted(removed(rows, 12))
    rep = [(1, "x" * 10 + passages[1]), (1, passages[1] + "y" * 9), (2, passages[1] + "!"), (2, passages[1] + "!"), (None, passages[1])]
    got = repeats.remove_repeats(docs(spark, rep)).collect()
    want = removed([(-1 if i is None else i, t) for i, t in rep], 50)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in got) == sorted((i, n) for i, _, n, _ in want)
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_triggers_cover_every_string():
    rng = np.random.default_rng(1)
    for raw in (rng.integers(97, 100, 3000).astype(np.uint8), np.full(200, 97, np.uint8), np.tile(np.arange(7, dtype=np.uint8), 60)):
        pos, _, dmin, dmax = repeats.triggers(raw)
        starts = sorted(int(p - d) for p, a, b in zip(pos, dmin, dmax, strict=True) for d in range(a, b + 1))
        assert starts == list(range(len(raw) - 49))


def test_repeats_of_heavy_grams(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["the", "of", "th\u00e9", "ab", "zebra", "\x00"])
    phrase = "a frequent phrase of some forty bytes here"
    rows = [(i, " ".join(word() for _ in range(9)) + phrase + " ".join(word() for _ in range(rnd.randrange(9)))) for i in range(60)]
    rows += [(60, phrase * 6), (61, phrase * 5 + "z"), (62, "a" * 300), (63, "b" + "a" * 200), (64, rows[0][1]), (5, "x" + phrase + " of the of")]
    rnd.shuffle(rows)
    found = []
    heavy = repeats.heavy_hits
    monkeypatch.setattr(repeats, "heavy_hits", lambda *a: found.append(heavy(*a)) or found[-1])
    for bound, min_len in ((0, 50), (8, 50), (8, 12)):
        monkeypatch.setattr(repeats, "GROUP_ROWS", bound)
        got = repeats.remove_repeats(docs(spark, rows), min_len=min_len).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(removed(rows, min_len))
    assert len(found) == 3 and all(f.count() for f in found)


def test_repeats_of_grams_that_share_a_rolling_hash(spark):
    """Texts made so that two of their grams have one polynomial hash: nothing of 50 bytes repeats in them."""
    a = "bplaalsreegkdajcffjkbmxwdiasoqweuanegzlrvycjzsjbqfqcxyaqzddcxmycrqnqdaquxulx"
    b = "bplaalsreegkdajcffjkbmxwdicolswetakbhvjpyvejzuncreqcxyaqzddcxmycrqnqdaquxulx"
    got = repeats.remove_repeats(docs(spark, [(1, a), (2, b)])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}
    raw = np.frombuffer((a + b).encode(), np.uint8)
    one, other = repeats.gram_hash(raw, np.array([26]), 24, 5), repeats.gram_hash(raw, np.array([len(a) + 26]), 24, 5)
    assert one != other and one == repeats.gram_hash(raw, np.array([26]), 24, 5) and one != repeats.gram_hash(raw, np.array([26]), 24, 6)


def test_frequent_grams_go_by_half_of_what_surrounds_them(spark, monkeypatch):
    """Triggers of a frequent gram in the many texts that share it alone are in no common group; texts are read once for all grams."""
    phrase = "one phrase of forty bytes that all texts hold"
    rows = [(i, f"{i * 7919 % 1000:03d}{phrase}{i * 104729 % 1000:03d}") for i in range(100)]
    rows += [(200, "the beginning of it all, " + phrase + "000"), (201, "the beginning of it all, " + phrase + "111")]
    monkeypatch.setattr(repeats, "GROUP_ROWS", 4)
    got = repeats.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(removed(rows, 50))
    raw = np.frombuffer("".join(t for _, t in rows[:2]).encode(), np.uint8)
    before, after = (np.stack([raw[s : s + 26] for s in x]) for x in ([0, 51], [25, 76]))
    row, group, lo, hi = repeats._halves(np.array([5, 5]), before, after, np.array([0, 14]), np.array([26, 20]), 9)
    assert list(zip(row, lo, hi, strict=True)) == [(0, 13, 26), (1, 14, 20), (0, 0, 12)]
    assert len(set(group)) == 3
    g, k = np.zeros(300, np.int64), np.arange(300)
    b = np.zeros((300, 26), np.uint8)
    b[:, 25] = k % 128  # 128 contexts that differ in the farthest byte before
    b = b[np.argsort(k % 128, kind="stable")]
    k = k[np.argsort(k % 128, kind="stable")]
    flat = lambda x: pa.array([y.tobytes() for y in x], pa.binary())
    num = lambda x: pa.array(np.full(300, x).astype(np.int32))
    cols = [pa.array(g), flat(b), flat(np.zeros((300, 26), np.uint8)), num(26), num(26), pa.array(k), pa.array(k), num(7), num(0), num(26), pa.array(np.zeros(300, bool))]
    batch = pa.RecordBatch.from_arrays(cols, ["g", "before", "after", "la", "ra", "k", "th", "pos", "dmin", "dmax", "settled"])
    for step in (300, 7):
        for most in (1000, 20):
            out = pa.Table.from_batches(list(repeats._repeated((batch.slice(i, step) for i in range(0, 300, step)), 26, most))).to_pylist()
            assert any(r["s"] is not None for r in out) == (most == 20)
            least, bits = {}, {}
            for r in out:
                if r["s"]:
                    least[r["s"]] = min(least.get(r["s"], 999), r["k"])
            for r in out:
                if not r["s"] or r["k"] > least[r["s"]]:
                    bits[r["k"]] = bits.get(r["k"], 0) | r["mask"]
            assert bits == {i: (1 << 26) - 1 if i < 128 else (1 << 27) - 1 for i in range(1, 300)}
