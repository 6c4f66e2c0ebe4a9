"""Queries that SQL does not express, against plain programs of one process over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from spanlake.llm import near, quality, queries, toxicity
from spanlake.llm.tokens import word_bpe_path

DIR = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def read(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pandas()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def training(name, docs):
    """Texts and labels of the rows that may teach."""
    lab = read("labels").dropna(subset=[name]).drop_duplicates("doc_id").set_index("doc_id")[name]
    return [(t or "", int(lab[i])) for i, t in zip(docs.doc_id, docs.text, strict=True) if fold(i, 5) and i in lab.index]


def quality_scores(docs, texts):
    """Class densities by numpy's own means and covariances over all training rows."""
    x, y = zip(*training("quality", docs), strict=True)
    x, y = np.array([quality.statistics(t) for t in x]), np.array(y)
    z = np.array([quality.statistics(t or "") for t in texts])
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    both = sum((y == c).sum() * cov[c] for c in (0, 1)) / len(y)
    logs = []
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * both
        s = 0.95 * s + 0.05 * np.diag(np.diag(both)) + 1e-6 * np.eye(len(s))
        d = z - x[y == c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    prior = ((y == 1).sum() + 1) / (len(y) + 2)
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + math.log(prior / (1 - prior)), -500, 500)))


def test_quality_equals_numpy(spark):
    docs = read("documents")
    want = quality_scores(docs, docs.text)
    got = queries.op5_quality(spark, DIR).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and np.allclose(got.loc[docs.doc_id].score, want, atol=1e-9)
    assert (got.loc[docs.doc_id].predicted.to_numpy() == (want >= 0.3)).all()
    assert (got.loc[docs.doc_id].held_out.to_numpy() == [fold(i, 5) == 0 for i in docs.doc_id]).all()


def test_toxicity_counts_equal_a_counter(spark):
    docs = read("documents")
    c, n = [Counter(), Counter()], [0, 0]
    for t, y in training("toxic", docs):
        c[y].update(set(toxicity.gram_buckets(t).tolist()))
        n[y] += 1
    a = toxicity.SMOOTH * n[1] + 5
    want = np.zeros(1 << toxicity.BITS)
    for k in {*c[0], *c[1]}:
        p, q = ((c[y][k] + a * n[y] / sum(n)) / (n[y] + a) for y in (1, 0))
        want[k] = math.log(p / q) if abs(math.log(p / q)) >= toxicity.MIN_RATIO else 0
    d, lab = (spark.read.parquet(f"{DIR}/{x}.parquet") for x in ("documents", "labels"))
    r, n0, n1 = toxicity.feature_ratios(d, lab)
    assert (n0, n1) == tuple(n) and np.allclose(r[list({*c[0], *c[1]})], want[list({*c[0], *c[1]})])
    # every row is the logistic of the summed weights of its distinct features
    w, b = toxicity.train(d, lab)
    got = queries.op7_toxicity(spark, DIR).toPandas().set_index("doc_id").loc[docs.doc_id].score
    plain = [1 / (1 + math.exp(-(b + sum(w[k] for k in set(toxicity.gram_buckets(t or "").tolist()))))) for t in docs.text]
    assert np.allclose(got, plain, atol=1e-9)


def test_grams_are_of_characters():
    count = lambda t: len(toxicity.gram_buckets(t))
    assert count("abcdef") == count("абвгде") == count("日本語日本語") == count("😀😀😀😀😀😀")
    assert set(toxicity.gram_buckets("ДОМ\tA").tolist()) == set(toxicity.gram_buckets("дом a").tolist())


def kept_of_groups(rows):
    """One row of each component of texts that are alike, that of the least id."""
    sets = [set(near.ngram_set(t or "").tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for k, r in enumerate(rows) if find(k) == k]


def cut_leaks(rows, items):
    norm = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: [m.group().translate({c: c + 32 for c in range(65, 91)}) for m in norm.finditer(t)]
    wins = {}
    for t in items:
        w = low(t or "")
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(k, set()).add(tuple(w[i : i + k]))
    out = []
    for doc, t in rows:
        spots = [m.span() for m in norm.finditer(t or "")]
        w = low(t or "")
        hit = np.zeros(len(w), bool)
        for k, some in wins.items():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in some:
                    hit[i : i + k] = True
        if hit.sum() > 0.5 * len(w):
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(int)))
        for s, e in reversed(list(zip(edges[::2], edges[1::2], strict=True))):
            t = t[: spots[s][0]] + t[spots[e - 1][1] :]
        out.append((doc, t))
    return out


def mixed(rows, source):
    size = {i: len(WORDS.findall(t or "")) for i, t in rows}
    names = sorted({source[i] for i, _ in rows})
    total = {s: sum(size[i] for i, _ in rows if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, whole = {}, sum(total.values())
    while True:
        free = [s for s in names if s not in capped]
        target = {s: (whole - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * total[s]]
        if not over:
            target |= capped
            break
        capped |= {s: 3.0 * total[s] for s in over}
    out = []
    for s in names:
        full, rest = divmod(math.floor(target[s] + 0.5), total[s])
        at = 0
        for i, t in sorted((r for r in rows if source[r[0]] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            out += [(i, t)] * (full if size[i] else 0)
            take = max(0, min(size[i], rest - at))
            if take:
                out.append((i, t[: [m.end() for m in WORDS.finditer(t)][take - 1]] if take < size[i] else t))
            at += size[i]
    return out


def test_pipeline_equals_plain_programs(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = read("documents")
    good = quality_scores(docs, docs.text) >= 0.3
    rows = sorted((int(i), t) for i, t, g in zip(docs.doc_id, docs.text, good, strict=True) if g)
    rows = cut_leaks(kept_of_groups(rows), read("benchmark").text)
    rows = mixed(rows, dict(zip(docs.doc_id.astype(int), docs.source, strict=True)))
    lib = Tokenizer.from_file(word_bpe_path())
    want = []
    for i, t in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, DIR).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    # the mix stays mixed: repeats are apart, and prefixes of the file keep the weights of the sources
    ids = [r.doc_id for r in got]
    assert sum(a == b for a, b in zip(ids, ids[1:], strict=False)) < 0.05 * len(ids)
    source = dict(zip(docs.doc_id.astype(int), docs.source, strict=True))
    whole = {s: sum(r.n_tokens for r in got if source[r.doc_id] == s) for s in set(source.values())}
    total = sum(whole.values())
    half, seen = {s: 0 for s in whole}, 0
    for r in got:
        if seen < total / 2:
            half[source[r.doc_id]] += r.n_tokens
            seen += r.n_tokens
    assert all(abs(half[s] / seen - whole[s] / total) < 0.12 for s in whole)


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    def tables(name, rows, labels=(), items=()):
        d = str(tmp_path / name)
        for t, r, s in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long, own string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
            spark.createDataFrame(list(r), s).coalesce(1).write.parquet(f"{d}/{t}.parquet")
        return d

    text = "some plain words of a text that says this and that number {}"
    rows = [(i, text.format(i) * (i + 1), "en", "ab"[i % 2], 1, "x") for i in range(6)] + [(None, "a text without an id of its own", None, None, None, None), (7, None, None, "a", None, None), (8, "", "en", "b", 0, "x")]
    assert corpus_pipeline.run(spark, tables("empty", [])).count() == 0
    got = [r.doc_id for r in corpus_pipeline.run(spark, tables("bare", rows)).collect()]
    assert {0, 5, None} <= set(got) and not {7, 8} & set(got)
