"""The language model against sequential programs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import attention, lm

SCHEMA = "doc_id long, text string"
BLOCK, DIM = attention.BLOCK, attention.DIM


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def split(t):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]


def test_base_scores(spark):
    rnd = random.Random(1)
    words = ["the", "The", "of", "zebra", "don't", "été,", "x y", "end."]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "the of"), (3, "the the"), (202, "unseenword " * 3), (203, " \t the  of\n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit(1), "rid": F.lit(2), "c": F.lit(3), "known": F.lit("x"), "score": F.lit(9)})
    got = lm.score_texts(df).toPandas()
    c = Counter(w for i, t in rows if not fold(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((fold(i), len(split(t)), sum(c[w] > 0 for w in split(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)
    assert sorted(zip(got.held_out, got.n_tokens, got.n_known, got.base_score.round(6), strict=True)) == want
    assert (got.train_tokens == n).all() and (got.score <= 1e-9).all() and got.score.notna().all()


def test_without_training_rows(spark):
    held = [i for i in range(60) if fold(i)]
    got = lm.score_texts(spark.createDataFrame([(i, "some words here" * (k % 2)) for k, i in enumerate(held)], SCHEMA)).collect()
    assert len(got) == len(held) and all(r.held_out and r.n_known == r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in got)
    assert lm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    text = "the cat sat on a mat and " * 60_000  # 1.5 MB, in one slice of its own
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame([(1, text), (2, "the cat")], SCHEMA)).collect()}
    assert got[1].n_tokens == 420_001 and np.isfinite(got[1].score)


def prose(rnd, start, n):
    """Sentences in which a word is mostly followed by one of two."""
    words = [f"{a}{b}" for a in ("ba", "ro", "mi", "tel", "sun") for b in ("ton", "ker", "la", "ding", "vos", "pim")]
    after = {w: rnd.sample(words, 2) for w in words}
    rows = []
    for i in range(start, start + n):
        w, out = rnd.choice(words), []
        for _ in range(60):
            out.append(w)
            w = rnd.choice(after[w]) if rnd.random() < 0.9 else rnd.choice(words)
        rows.append((i, " ".join(out)))
    return rows


def test_training_helps_on_held_out_documents_of_known_words(spark):
    """All words are known here, so that the unigram base is a true distribution and can be compared with."""
    df = spark.createDataFrame(prose(random.Random(4), 0, 700), SCHEMA)
    mean = {}
    for name, kw in (("trained", {"share": 1}), ("untrained", {"rounds": 0})):
        p = lm.score_texts(df, **kw).where("held_out and n_known = n_tokens").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.count("*")).first()
        mean[name], mean["base"] = p[0] / p[2], p[1] / p[2]
        assert p[3] > 50
    assert mean["trained"] > mean["base"] + 0.1 and mean["trained"] > mean["untrained"] + 0.1


def net_of(rng, n=9):
    net = attention.Network(attention.Tree(rng.integers(1, 50, n)))
    for k in ("far", "e", "u"):
        net.p[k] = rng.standard_normal(net.p[k].shape).astype(np.float32)
    net.freeze()
    return net


def test_blocks_equal_plain_masked_attention():
    rng = np.random.default_rng(3)
    net = net_of(rng, 40)
    lens = np.array([1, 5, 16, 17, 50])
    body = rng.integers(0, 39, lens.sum())
    body[np.cumsum(lens) - 1] = 39
    got = np.concatenate(list(net.log_probs(attention.Blocks(body, lens, 39), slab=3, step=2)))
    t = (net.p["e"] @ net.p["w"]).reshape(40, 4, DIM)
    want, at = [], 0
    for n in lens:
        seq = body[at : at + n]
        inp = np.concatenate(([39], seq[:-1]))
        for i in range(n):
            lo = max(0, (i // BLOCK - 1) * BLOCK)
            keys = inp[lo : i + 1]
            s = t[keys, 1] @ t[inp[i], 0] / np.sqrt(DIM) + net.p["far"][i - np.arange(lo, i + 1)]
            a = np.exp(s - s.max())
            h = np.tanh((a / a.sum()) @ t[keys, 2] + t[inp[i], 3])
            want.append(net.tree.walk(net.p["u"], net.p["b"], h[None].astype(np.float32), seq[i : i + 1])[0])
        at += n
    assert np.allclose(got, want, atol=1e-4)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 300, 5000])
def test_tree_is_a_distribution(n):
    rng = np.random.default_rng(n)
    weights = rng.zipf(1.3, n).astype(float)
    tree = attention.Tree(weights)
    u, b = np.zeros((len(tree.child), DIM, attention.RADIX), np.float32), tree.bias
    h = rng.standard_normal((1, DIM)).astype(np.float32)
    ids = np.arange(n)
    free = np.exp(tree.walk(u, b, np.repeat(h, n, axis=0), ids))
    assert np.allclose(free, weights / weights.sum(), rtol=1e-3)  # untrained: the smoothed frequencies
    u = rng.standard_normal(u.shape).astype(np.float32)
    order = rng.permutation(n)
    p = np.exp(tree.walk(u, b, np.repeat(h, n, axis=0), order))
    assert abs(p.sum() - 1) < 1e-3
    assert np.allclose(p[:5], [np.exp(tree.walk(u, b, h, order[i : i + 1]))[0] for i in range(min(5, n))], rtol=1e-3)


def test_inner_children_of_the_tree():
    tree = attention.Tree(np.arange(1, 5001.0) ** 2)
    want = [[(c, k - tree.n_ids) for c, k in enumerate(row) if k >= tree.n_ids] for row in tree.child.tolist()]
    assert tree.inner == want and sum(map(len, tree.inner)) == len(tree.child) - 1  # every node but the root is a child once
    a = np.random.default_rng(3).standard_normal((5, 4, 32)).astype(np.float32)
    assert np.array_equal(attention._greatest(a), a.max(axis=2, keepdims=True))


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    net = net_of(rng, 60)
    lens = np.array([20, 3, 40])
    body = rng.integers(0, 59, lens.sum())
    blocks = attention.Blocks(body, lens, 59)
    _, n, grads = net.gradient(blocks, 1, len(blocks))
    for k, (rows, g) in grads.items():
        whole = np.zeros_like(net.p[k])
        whole[slice(None) if rows is None else rows] = g
        i = np.unravel_index(np.argmax(np.abs(whole)), whole.shape)
        was, ends = net.p[k][i], []
        for step in (0.02, -0.02):
            net.p[k][i] = was + step
            ends.append(net.gradient(blocks, 1, len(blocks))[0] / n)
        net.p[k][i] = was
        assert abs((ends[0] - ends[1]) / 0.04 - whole[i]) < 0.05 * abs(whole[i]) + 1e-4, k


def test_word_probabilities_sum_to_one():
    """Over all words that begin with an id, counts and the network share exactly that id's probability."""
    m = lm.Model.__new__(lm.Model)
    m.discount, m.begin, m.kinds = 0.6, np.array([0.0, 10.0, 0.0]), np.array([0.0, 3.0, 0.0])
    counts, q = np.array([5.0, 4.0, 1.0, 0.0, 0.0]), np.array([0.2, 0.1, 0.3, 0.15, 0.25])
    head = np.log(np.full(5, 0.4))
    logs, _ = m.log10(counts, np.full(5, 1), head, head + np.log(q))
    assert abs((10**logs).sum() - 0.4) < 1e-9


def test_shards_hold_every_training_document_of_the_share(spark, monkeypatch):
    tokenizer = lm.word_bpe_path()
    rows = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(20 + i % 9))) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0], (None, None), (None, "")], SCHEMA)
    words = lm.word_counts(df)
    n = words.agg(F.sum("c")).first()[0]
    total = int(lm.id_counts(words, tokenizer)[0].sum())
    monkeypatch.setattr(lm, "SHARD_IDS", total // 3)
    seen = []
    shards = lm.shard_texts
    monkeypatch.setattr(lm, "shard_texts", lambda *a: seen.append(shards(*a)) or seen[-1])
    model, losses = lm.train_model(df, words, n, tokenizer, share=1)
    told = seen[0].collect()
    assert len(told) > 6 and {r.round for r in told} == {0, 1, 2, 3} and all(r.round == r.shard % 4 for r in told)
    assert sum(r.n for r in told) == sum(len(r.body) // 4 for r in told) == total
    assert sum(len(r.lens) // 4 for r in told) == len(rows) + 3
    assert len(losses) == 4 and losses[-1] < losses[0]
    assert model.net.tree.n_ids == 2 * 49408 + 1  # every id has an output of its own
    lm.train_model(df, words, n, tokenizer, share=4)
    assert 0 < sum(r.n for r in seen[1].collect()) < total


def test_one_shard_is_plain_descent(spark):
    body, lens = np.tile([1, 2, 3, 4, 0], 400).astype(np.int32), np.full(100, 20, np.int32)
    taught = spark.createDataFrame([(0, 0, 2000, body.tobytes(), lens.tobytes()), (1, 1, 2000, body.tobytes(), lens.tobytes())], "shard long, round long, n long, body binary, lens binary")
    tree = attention.Tree(np.full(5, 2.0))
    net, alone = attention.Network(tree), attention.Network(tree)
    losses = lm.train_shards(net, taught, 2, batch=8)
    scales, want = alone.scales(), []
    for r in range(2):
        loss, n, _ = alone.descend(attention.Blocks(body, lens.astype(np.int64), 4), scales, lm.RATE, 8, np.random.default_rng([11, r, r]))
        want.append(loss / n)
    assert np.allclose(losses, want, rtol=1e-3) and losses[1] < losses[0]
    assert all(np.allclose(net.p[k], alone.p[k], atol=1e-4) for k in net.p)


def test_rows_of_weights_come_to_a_worker_one_by_one(spark, monkeypatch):
    sizes = []

    def rows(s, n):
        sizes.append(n)
        return arrow_rows(s, n)

    arrow_rows = lm.arrow_rows
    monkeypatch.setattr(lm, "arrow_rows", rows)
    body, lens = np.tile([1, 2, 3, 4, 0], 40).astype(np.int32), np.full(10, 20, np.int32)
    taught = spark.createDataFrame([(i, 0, 200, body.tobytes(), lens.tobytes()) for i in range(9)], "shard long, round long, n long, body binary, lens binary")
    net, alone = (attention.Network(attention.Tree(np.full(5, 2.0))) for _ in range(2))
    lm.train_shards(net, taught, 1, batch=8)
    assert sizes == [1]
    blocks = attention.Blocks(body, lens.astype(np.int64), 4)
    changes = []
    for i in range(9):
        own = attention.Network.__new__(attention.Network)
        own.tree, own.p = alone.tree, {k: w.copy() for k, w in alone.p.items()}
        own.descend(blocks, alone.scales(), lm.RATE, 8, np.random.default_rng([11, 0, i]))
        changes.append(own.p["far"] - alone.p["far"])
    assert np.allclose(net.p["far"], alone.p["far"] + np.mean(changes, axis=0), atol=1e-5)


def test_paths_and_gradients_of_the_tree_equal_plain_softmaxes():
    """Nodes of one row, of few and of more than go at a time, each against its own softmax."""
    rng = np.random.default_rng(8)
    n, rows = 3000, 9000
    tree = attention.Tree(rng.zipf(1.3, n).astype(float))
    goal = np.concatenate((rng.integers(0, n, 1000), np.minimum(rng.zipf(1.4, rows - 1000) - 1, n - 1)))
    u = rng.standard_normal((len(tree.child), DIM, attention.RADIX)).astype(np.float32) / 4
    h, weight = np.tanh(rng.standard_normal((rows, DIM))).astype(np.float32), rng.random(rows).astype(np.float32)
    logs, by_h, (nodes, by_u, by_b) = tree.walk(u, tree.bias, h, goal, weight)
    assert len(set(nodes.tolist())) == len(nodes) and np.allclose(logs, tree.walk(u, tree.bias, h, goal), atol=1e-5)
    want, dh, du, db = np.zeros(rows), np.zeros(h.shape), np.zeros(u.shape), np.zeros(tree.bias.shape)
    leaf = tree.rank.astype(int)
    for i in range(rows):
        k, steps = tree.root, []
        while k >= 0:
            c = next(c for c in range(attention.RADIX) if tree.edge[k, c + 1] > leaf[goal[i]])
            steps.append((k, c))
            z = (h[i] @ u[k] + tree.bias[k]).astype(np.float64)
            p = np.exp(z - z.max())
            p /= p.sum()
            want[i] += np.log(p[c])
            p[c] -= 1
            p *= weight[i]
            dh[i] += u[k] @ p
            du[k] += np.outer(h[i], p)
            db[k] += p
            k = tree.child[k, c] - tree.n_ids
        told = [(path[leaf[goal[i]]], digit[leaf[goal[i]]]) for path, digit in zip(tree.path, tree.digit, strict=True) if path[leaf[goal[i]]] >= 0]
        assert told == steps
    assert np.allclose(logs, want, atol=1e-3) and np.allclose(by_h, dh, atol=1e-3)
    assert np.allclose(by_u, du[nodes], atol=1e-2) and np.allclose(by_b, db[nodes], atol=1e-2)
    assert not np.delete(du, nodes, axis=0).any()


def test_shards_of_one_task_start_from_the_common_weights(spark):
    """Two shards that touch other ids, through one task, against each alone."""
    lens = np.full(10, 20, np.int32)
    bodies = [np.tile([*ids, 39], 40).astype(np.int32) for ids in ((1, 2, 3, 4), (20, 21, 22, 3))]
    rows = [(i, 0, 200, b.tobytes(), lens.tobytes()) for i, b in enumerate(bodies)]
    taught = spark.createDataFrame(rows, "shard long, round long, n long, body binary, lens binary").coalesce(1)
    tree = attention.Tree(np.full(40, 2.0))
    net, start = attention.Network(tree), attention.Network(tree)
    lm.train_shards(net, taught, 1, batch=8)
    change, times = np.zeros_like(start.p["e"]), np.zeros(40)
    for i, b in enumerate(bodies):
        own = attention.Network(tree)
        touched = own.descend(attention.Blocks(b, lens.astype(np.int64), 39), own.scales(), lm.RATE, 8, np.random.default_rng([11, 0, i]))[2]["e"]
        change += (own.p["e"] - start.p["e"]) * touched[:, None]
        times += touched
    assert (times == 0).any() and np.allclose(net.p["e"], start.p["e"] + change / np.maximum(times, 1)[:, None], atol=1e-5)


def test_frequent_words_are_encoded_first_and_kept(monkeypatch):
    monkeypatch.setattr(lm, "KEEP_WORDS", 5)
    first = ["the", "and", "x" * (lm.FIRST_LETTERS + 1), "of"]
    texts, plain = lm.TextIds(lm.word_bpe_path(), first), lm.TextIds(lm.word_bpe_path())
    assert list(texts.table.index) == [lm.END, "the", "and", "of"]
    codes, words, _ = lm.text_words(lm.pa.array(["Seldom of the others and rarely", ""]))
    assert np.array_equal(texts.body(texts.numbers(codes, words)), plain.body(plain.numbers(codes, words)))
    texts.table.trim(lm.KEEP_WORDS, lm.KEEP_LETTERS)
    assert list(texts.table.index)[:4] == [lm.END, "the", "and", "of"] and len(texts.table.index) == 5
