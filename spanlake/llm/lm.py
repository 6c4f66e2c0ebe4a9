"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Spark counts all words of the training documents; their subword ids (each with a mark for the last id of a word),
weighted by those counts, give the id counts of the whole training corpus, which shape the output tree of the network
of ``attention``. The network predicts every next id, out of all ids, from the ids before it. Given a word's first id,
the word's own count among the training words that begin so, discounted as in Kneser and Ney's smoothing, is
interpolated with the network's probability of its other ids. Together this is one normalised model of word sequences
with an end, and a text's score is the log10 of its probability.

Counts cover all training documents, and the network's weights are fitted on all of them (``SHARE`` 1: one in ``SHARE`` by a
hash); a hash deals these to ``ROUNDS`` rounds and to a shard for every ``SHARD_IDS`` ids, so that a shard
has about ``SHARD_IDS / ROUNDS`` ids in a round, and more text makes more shards but no longer ones. In a round,
Spark tasks take the common weights once through every shard of the round, and the changes, averaged row by row over
the shards that touched a row, make the next common weights; the driver holds weights only. Scoring cuts a text into
blocks; a window is a block with the block before it, so every id is scored once, with at least a block of ids before
it where there are as many, and the masked attention of many windows is one product.

The most frequent words' counts go to all workers (at most ``HOT_WORDS``), the rest meet their counts in a join.

Defined results: a null text is empty and has the end token only; a null doc_id counts as the empty text in the
fold; repeated rows are scored and learnt each; an empty table gives an empty result; without training rows all counts
are 0, the base is 0 and the model is uniform over the ids; a text of any length is scored whole; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import on_workers
from .attention import Blocks, Network, Tree
from .common import arrow_rows, crc_mod, hold, materialize, release_memory, slices, sorted_groups, text_or_empty
from .tokens import word_bpe_path
from .wordbpe import IdTable, WordEncoder, gather, split_words, vocabulary

FOLDS, HELD_OUT = 7, 2
HOT_WORDS = 200_000
SHARE = 1
ROUNDS = 4
SHARD_IDS = 500_000
BATCH, RATE = 256, 0.05  # blocks a step, and AdaGrad's rate
KEEP_WORDS, KEEP_LETTERS = 300_000, 1 << 23
FIRST_LETTERS = 64  # longer words are not encoded before they come
SCORE_BYTES = 1 << 20  # of text at a time
END = "\n"  # no word holds white space, so this key of the end token is free


def text_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``(codes, words, sizes)``: ``words[codes]`` are the words of all texts one after another, A-Z lower-cased, each
    text's followed by the code -1 for its end; ``sizes`` counts a text's words and end."""
    codes, words, ends = split_words(pc.ascii_lower(texts))
    blank = pc.index(words, "").as_py()
    if blank >= 0:
        keep = codes != blank
        ends = np.concatenate(([0], np.cumsum(keep)))[ends]
        codes = codes[keep]
    return np.insert(codes, ends[1:], -1), words, np.diff(ends) + 1


def word_ids(encoder: WordEncoder, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of all words one after another, doubled, and one more for the last of a word; and how many
    each word has. ``END`` has none here."""
    flat, sizes = encoder.word_ids(words)
    flat = flat.astype(np.int32) * 2
    flat[np.cumsum(sizes)[sizes > 0] - 1] += 1
    return flat, sizes


# ---------------------------------------------------------------- counts


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all rows of ``docs``, the end token included."""

    def summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
        yield from pa.table({"word": t["word"], "c": t["c_sum"]}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches, 4000, 8 << 20):
            codes, words, _ = text_words(b.column(0))
            c = np.bincount(codes + 1, minlength=len(words) + 1)
            held.append(pa.table({"word": pa.concat_arrays([pa.array([END]), words]), "c": c}).filter(pa.array(c > 0)))
            n += len(words)
            if n > 1_000_000:
                yield from summed(held)
                held, n = [], 0
        if held:
            yield from summed(held)

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(words: DataFrame, tokenizer: str) -> np.ndarray:
    """Over the counted words, by id: its count, the count of words that begin with it, and the number of such words.

    ``(3, ids)``, the end id last; at most a row for each id comes to the driver.
    """
    vocab = 2 * vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder.of(tokenizer, "lm")
        c = np.zeros((3, vocab + 1))
        for b in slices(batches, 20_000):
            w, k = b.column(0).to_numpy(zero_copy_only=False).tolist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            flat, sizes = word_ids(enc, w)
            end = np.array([x == END for x in w])
            c[0] += np.bincount(flat, weights=np.repeat(k, sizes), minlength=vocab + 1)
            some = sizes > 0
            head = flat[(np.cumsum(sizes) - sizes)[some]]
            c[1] += np.bincount(head, weights=k[some], minlength=vocab + 1)
            c[2] += np.bincount(head, minlength=vocab + 1)
            c[:, vocab] += k[end].sum(), k[end].sum(), end.sum()
        k = np.flatnonzero(c.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(x[k]) for x in c)], ["id", "n", "c", "v"])

    got = words.select("word", "c").mapInArrow(run, "id int, n double, c double, v double")
    sums = got.groupBy("id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("v").alias("v")).toPandas()
    out = np.zeros((3, vocab + 1))
    out[:, sums["id"].to_numpy()] = sums["n"].to_numpy(), sums["c"].to_numpy(), sums["v"].to_numpy()
    return out


def hot_words(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words, by steps of the logarithm of the count as far as at most ``most`` fit in.

    A row for each step (under 2,100) comes to the driver, and no more than ``most`` words are ever gathered.
    """
    step = F.floor(F.log2("c") * 32).cast("int")
    sizes = {r.s: r.n for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    least, left = 1 << 20, most
    for s in sorted(sizes, reverse=True):
        left -= sizes[s]
        if left < 0:
            break
        least = s
    return words.where(step >= least).select("word", "c")


# ---------------------------------------------------------------- training


_texts: dict[str, TextIds] = {}


class TextIds:
    """The ids of texts: their words by number, those of ``first`` and of what comes next kept between slices; number 0 is the end."""

    def __init__(self, tokenizer: str, first: Iterable[str] = ()):
        encoder = WordEncoder.of(tokenizer, "lm")
        self.end = 2 * encoder.vocab_size

        def ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            flat, sizes = word_ids(encoder, words)
            if words[:1] == [END]:
                flat, sizes[0] = np.concatenate((np.array([self.end], np.int32), flat)), 1
            return flat, sizes

        self.table = IdTable(ids)
        self.table.numbers([END])
        for words in batched((w for w in first if len(w) <= FIRST_LETTERS), 20_000):
            self.table.numbers(list(words))
        self.table.trim(KEEP_WORDS, KEEP_LETTERS)

    @staticmethod
    def of(tokenizer: str, first: Iterable[str] = ()) -> TextIds:
        """One a process and tokenizer."""
        hold("lm", _texts.clear)
        if tokenizer not in _texts:
            _texts[tokenizer] = TextIds(tokenizer, first)
        return _texts[tokenizer]

    def numbers(self, codes: np.ndarray, words: pa.Array) -> np.ndarray:
        """Numbers of all words and ends of ``text_words``."""
        return np.append(self.table.numbers(words.to_numpy(zero_copy_only=False).tolist()), 0)[codes]

    def body(self, numbers: np.ndarray) -> np.ndarray:
        step = 1 << 17
        return np.concatenate([gather(self.table.flat, self.table.start, self.table.size, numbers[s : s + step]) for s in range(0, max(1, len(numbers)), step)])


def _hash(label: str) -> Column:
    return F.xxhash64(F.lit(label), F.col("doc_id").cast("string"), F.octet_length(text_or_empty()))


def shard_texts(train: DataFrame, tokenizer: str, ids: float, share: int, rounds: int, shard_ids: int, known: Broadcast | None = None) -> DataFrame:
    """``(shard, round, n, body binary, lens binary)``: the ids of the texts of a shard one after another, a row a shard.
    The words ``known`` are encoded first and kept."""
    shards = max(1, -(-int(ids / share) // shard_ids))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = TextIds.of(tokenizer, known.value if known else ())
        for b in slices(batches):
            codes, words, sizes = text_words(b.column(2))
            numbers = texts.numbers(codes, words)
            body, n = texts.body(numbers), np.concatenate(([0], np.cumsum(texts.table.size[numbers])))
            ends = np.concatenate(([0], n[np.cumsum(sizes)])).astype(np.int32) * 4
            texts.table.trim(KEEP_WORDS, KEEP_LETTERS)
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(body.astype(np.int32))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw], ["shard", "h", "body"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 1):
            texts = g.column(2).to_pylist()
            lens = np.array([len(t) // 4 for t in texts], dtype=np.int32)
            shard = g.column(0)[0].as_py()
            cols = [pa.array([shard]), pa.array([shard % rounds]), pa.array([int(lens.sum())]), pa.array([b"".join(texts)]), pa.array([lens.tobytes()])]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "round", "n", "body", "lens"])

    taken = train.where(F.pmod(_hash("share"), F.lit(share)) == 0)
    rows = taken.select(F.pmod(_hash("shard"), F.lit(shards * rounds)).cast("long").alias("shard"), _hash("order").alias("h"), text_or_empty().alias("text"))
    rows = rows.mapInArrow(encoded, "shard long, h long, body binary").repartition("shard").sortWithinPartitions("shard", "h")
    return materialize(rows.mapInArrow(pack, "shard long, round long, n long, body binary, lens binary"), "shards")


def _flat(parts: list[dict[str, np.ndarray]]) -> np.ndarray:
    return np.concatenate([d[k].ravel() for d in parts for k in sorted(d)]).astype(np.float32, copy=False)


def _unflat(flat: np.ndarray, like: list[dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    out, at = [], 0
    for d in like:
        out.append({})
        for k in sorted(d):
            out[-1][k] = flat[at : at + d[k].size].reshape(d[k].shape)
            at += d[k].size
    return out


def _by_row(touched: np.ndarray, w: np.ndarray) -> np.ndarray:
    return touched.reshape(-1, *[1] * (w.ndim - 1)) if len(touched) == len(w) else touched[0]


def train_shards(net: Network, taught: DataFrame, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE) -> list[float]:
    """Fit ``net`` in rounds; the mean loss an id of each round that has shards. Changes are summed by Spark, and a
    row of the size of the weights comes to the driver. Such rows go to and from Python one by one."""
    spark = taught.sparkSession
    sc = spark.sparkContext
    scales, losses = net.scales(), []
    schema = "loss double, n double, sums binary"

    def row(loss: float, n: float, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([sums.tobytes()])], ["loss", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        loss, n, sums = 0.0, 0.0, None
        for b in batches:
            for i in range(b.num_rows):
                loss, n = loss + b.column(0)[i].as_py(), n + b.column(1)[i].as_py()
                one = np.frombuffer(b.column(2)[i].as_buffer(), np.float32)
                sums = one.copy() if sums is None else np.add(sums, one, out=sums)
        if sums is not None:
            yield row(loss, n, sums)

    for r in range(rounds):
        shared = sc.broadcast((net, scales))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            hold("lm-train", lambda: None)  # the texts are encoded: this worker's words and encoder may go
            release_memory()
            net, scales = shared.value
            loss, n, sums = 0.0, 0.0, None
            for b in batches:
                for shard, body, lens in zip(*(b.column(i) for i in range(3)), strict=True):
                    if sums is None:
                        own = Network.__new__(Network)
                        own.tree, own.p = net.tree, {k: w.copy() for k, w in net.p.items()}
                        mine = {k: s.copy() for k, s in scales.items()}
                        sums = [{k: np.zeros_like(w) for k, w in d.items()} for d in (net.p, scales, scales)]
                    blocks = Blocks(np.frombuffer(body.as_buffer(), np.int32), np.frombuffer(lens.as_buffer(), np.int32).astype(np.int64), net.tree.n_ids - 1)
                    was, seen, touched = own.descend(blocks, mine, rate, batch, np.random.default_rng([11, r, shard.as_py()]))
                    loss, n = loss + was, n + seen
                    for k, t in touched.items():
                        # what the shard touched is summed and set back for the next shard
                        at = np.flatnonzero(t) if len(t) == len(own.p[k]) else slice(None)
                        sums[2][k][at] += t[at]
                        for whole, theirs, now in ((sums[0], net.p, own.p), (sums[1], scales, mine)):
                            whole[k][at] += (now[k][at] - theirs[k][at]) * _by_row(t[at], now[k][at])
                            now[k][at] = theirs[k][at]
            if sums is not None:
                del own, mine
                yield row(loss, n, _flat(sums))

        parts = taught.where(F.col("round") == r).select("shard", "body", "lens").repartition("shard").mapInArrow(run, schema)
        tasks = int(taught.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while tasks > 1:
            tasks = math.isqrt(tasks)
            parts = parts.repartition(tasks).mapInArrow(add, schema)
        with arrow_rows(spark, 1):
            few = parts.collect()
        shared.destroy()
        if not few:
            continue
        change, wider, touched = _unflat(np.frombuffer(few[0].sums, np.float32), [net.p, scales, scales])  # one row
        for k, w in net.p.items():
            times = np.maximum(touched[k], 1)
            w += (change[k] / _by_row(times, w)).astype(np.float32)
            scales[k] += (wider[k] / times).astype(np.float32)
        losses.append(few[0].loss / few[0].n)
        del few, change, wider, touched
        release_memory()
    return losses


# ---------------------------------------------------------------- operator


class Model:
    """The network with the discounted counts of words by their first id."""

    def __init__(self, net: Network, begin: np.ndarray, kinds: np.ndarray, discount: float):
        self.net, self.begin, self.kinds, self.discount = net, begin, kinds, discount
        self.end = net.tree.n_ids - 1

    def log10(self, c: np.ndarray, k: np.ndarray, head: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the word's probability, and the weight ``x`` of its ids: with a count c it gains log10(1 + (c - D) / x)."""
        x = self.discount * self.kinds[k] * np.exp(whole - head)
        unseen = np.where(self.kinds[k] > 0, np.log(np.maximum(self.discount * self.kinds[k], 1e-300) / np.maximum(self.begin[k], 1)), 0.0)
        gain = np.log1p(np.maximum(c - self.discount, 0) / np.maximum(x, 1e-300))
        return (whole + unseen + np.where(c > 0, gain, 0)) / np.log(10), x

    def word_logs(self, texts: TextIds, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word and end of texts of ``sizes`` words: its first id, and the natural logs of the network's
        probabilities of that id and of all its ids."""
        body, n = texts.body(numbers), texts.table.size[numbers]
        ends = np.cumsum(n)
        lens = np.diff(np.concatenate(([0], ends[np.cumsum(sizes) - 1])))
        lp = np.concatenate([np.empty(0), *self.net.log_probs(Blocks(body, lens, self.end))])
        done, some = np.concatenate(([0.0], np.cumsum(lp))), n > 0  # a word the tokenizer makes nothing of costs nothing
        at = np.minimum(ends - n, len(lp) - 1)
        return np.where(some, body[at], self.end), np.where(some, lp[at], 0.0), done[ends] - done[ends - n]


def train_model(train: DataFrame, words: DataFrame, n_words: int, tokenizer: str, share: int = SHARE, rounds: int = ROUNDS, known: Broadcast | None = None) -> tuple[Model, list[float]]:
    """The model, and the mean loss of each round. A row for each id and the weights come to the driver."""
    counts, begin, kinds = id_counts(words, tokenizer)
    net = Network(Tree(counts + 1))
    once, twice = words.agg(F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    losses: list[float] = []
    if n_words and rounds:
        taught = shard_texts(train, tokenizer, float(counts.sum()), share, rounds, SHARD_IDS, known)
        losses = train_shards(net, taught, rounds)
    return Model(net, begin, kinds, once / (once + 2 * twice) if twice else 0.5), losses


class KnownCounts:
    """Counts of the words of a table by number."""

    def __init__(self, known: dict[str, int], table: IdTable):
        self.known, self.table, self.counts = known, table, np.empty(0)

    def all(self) -> np.ndarray:
        new = islice(self.table.index, len(self.counts), None)
        self.counts = np.concatenate((self.counts, np.fromiter(map(self.known.get, new, repeat(0)), np.float64)))
        return self.counts

    def trim(self) -> None:
        """After words were forgotten."""
        self.counts = self.counts[: len(self.table.index)]


_kept: dict[str, KnownCounts] = {}


def score_texts(docs: DataFrame, tokenizer: str | None = None, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    The network learns from one training document in ``share``; with no rounds it stays untrained.
    """
    spark = docs.sparkSession
    on_workers(spark)
    tokenizer = tokenizer or word_bpe_path()
    docs = docs.select("doc_id", "text")
    held = crc_mod("doc_id", FOLDS) == HELD_OUT
    train = docs.where(~held)
    words = materialize(word_counts(train), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = hot_words(words, HOT_WORDS).toPandas()
    counted = spark.sparkContext.broadcast(dict(zip(hot["word"].tolist(), hot["c"].tolist(), strict=True)))
    del hot
    model, _ = train_model(train, words, n, tokenizer, share, rounds, counted)
    release_memory()
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model))
    discount = float(model.discount)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("lm", _kept.clear)
        release_memory()  # what training left
        name, model = shared.value
        if name not in _kept:
            _kept.clear()
            _kept[name] = KnownCounts(counted.value, TextIds.of(tokenizer, counted.value).table)
            if not hasattr(model.net, "q"):
                model.net.freeze(final=True)
        texts, counts, rid = TextIds.of(tokenizer), _kept[name], TaskContext.get().partitionId() << 36
        for b in slices(batches, size=SCORE_BYTES):
            codes, names, sizes = text_words(b.column(1))
            numbers = texts.numbers(codes, names)
            k, head, whole = model.word_logs(texts, numbers, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            c = counts.all()[numbers]
            seen = c > 0
            total = lambda x, on: np.bincount(owner[on], weights=x, minlength=len(sizes)).astype(np.float64)  # noqa: E731, B023
            logs, x = model.log10(c, k, head, whole)
            rare = np.flatnonzero(~seen)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=len(sizes))))).astype(np.int32))
            names = pa.concat_arrays([names, pa.array([END], names.type)]).take(pa.array(np.where(codes[rare] < 0, len(names), codes[rare])))
            each = pa.StructArray.from_arrays([names, pa.array(x[rare])], ["word", "x"])
            cols = [pa.array(np.arange(rid, rid + b.num_rows)), b.column(0), pa.array(sizes), pa.array(np.bincount(owner[seen], minlength=len(sizes))), pa.array(total(np.log10(c[seen] + 1), seen)), pa.array(total(logs, slice(None))), pa.ListArray.from_arrays(offsets, each)]
            rid += b.num_rows
            texts.table.trim(KEEP_WORDS, KEEP_LETTERS)
            counts.trim()
            yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "n_tokens", "known", "logs", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"rid long, doc_id {kind}, n_tokens long, known long, logs double, score double, rare array<struct<word: string, x: double>>"
    )
    with arrow_rows(spark, 2000):
        rows = materialize(rows, "scored")
    rare = rows.select("rid", F.explode("rare").alias("w")).select("rid", F.col("w.word").alias("word"), F.col("w.x").alias("x"))
    # a word that is not hot was scored as unseen; where it has a count, the difference is added
    gain = F.log10(1 + F.greatest(F.col("c") - discount, F.lit(0.0)) / F.greatest("x", F.lit(1e-300)))
    found = rare.join(words, "word").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("seen"), F.sum(gain).alias("gain"))
    out = rows.drop("rare").join(found, "rid", "left")
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
