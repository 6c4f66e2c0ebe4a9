"""N-gram Jaccard join by MinHash banding.

Documents with the same set of word n-grams are one text. Each text's MinHash signature is cut into bands; the
number of bands and the rows in each are the cheapest that find a pair at the threshold with ``TARGET_RECALL``.
Band hashes are shuffled; buckets with the same members are one bucket; inside a bucket whole signatures are
compared and links that are likely enough (far below the threshold) tie texts into candidate groups by a spanning
forest, never as all pairs. Every candidate group is then checked on the full n-gram sets, each pair once, and
what comes out is a count of links for each text and a spanning forest of the verified links. Buckets and groups
over a few hundred texts are dealt in blocks against blocks, so that no task holds a whole large one.

Words are split at white space, in lower case. Defined results: a text of fewer words than n has one n-gram, all
of them; texts without words (null, empty, blank) are never linked; repeated rows are copies of one text; a null
doc_id is the least; where a class's least doc_id stands on several rows, the text of the least hash represents it; a
text of any length is read whole; extra columns are ignored, whatever their names (``drop_near_duplicates`` hands them
on); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_names, hold, map_arrow, materialize, sorted_groups, text_or_empty

N_WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.995
MAX_HASHES = 256
SLACK = 0.15
BUCKET_BLOCK = 512
SET_BLOCK = 128
_MUL = np.uint64(0x9E3779B97F4A7C15)
_words: dict[str, int] = {}


def choose_bands(threshold: float, recall: float, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The most selective ``(bands, rows)`` within ``hashes`` that find a pair at ``threshold`` with ``recall``."""
    best = (hashes, 1)
    for rows in range(1, 33):
        bands = hashes // rows
        if bands and 1 - (1 - threshold**rows) ** bands >= recall:
            need = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))) if threshold < 1 else 1
            best = (max(1, min(bands, need)), rows)
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    hold("near", _words.clear)
    if len(_words) > 100_000:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w.encode())
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def ngram_set(text: str, n: int = N_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * _MUL + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_id(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


@lru_cache(maxsize=4)
def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def signature(grams: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    a, c = _coefficients(hashes)
    out = np.full(hashes, 0xFFFFFFFF, dtype=np.uint64)
    for s in range(0, len(grams), 512):  # a slab stays in the cache of a core
        v = grams[s : s + 512, None] * a
        v += c
        v >>= np.uint64(32)
        np.minimum(out, v.min(axis=0), out=out)
    return out.astype(np.uint32)


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, th, sid, sig, bands)`` of every row; sid and what follows is null for texts without words."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sid, sig, keys = [], [], []
        for t in b.column(2):
            g = ngram_set(t.as_py(), n)
            if not len(g):
                sid.append(None), sig.append(None), keys.append(None)
                continue
            s = signature(g, bands * rows)
            sid.append(set_id(g))
            sig.append((s & 0xFF).astype(np.uint8).tobytes())
            k = np.arange(bands, dtype=np.uint64) + np.uint64(1)
            for r in range(rows):
                k = _mix(k * _MUL + s.reshape(bands, rows)[:, r])
            keys.append(k.view(np.int64))
        cols = [b.column(0), b.column(1), pa.array(sid, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "sid", "sig", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), text_or_empty().alias("text"))
    return map_arrow(d, run, f"doc_id {kind}, th long, sid long, sig binary, bands array<long>")


def _blocks(df: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows keyed by ``(key, i, j)``: a group of ``size`` rows is cut by a hash of sid into blocks, and every row goes
    to its block against each block. Small groups stay whole."""
    n = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), F.col("sid")), n.cast("long")).cast("long")
    out = df.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    return out.select(F.col(key).alias("g"), F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"), F.col("_mine").alias("mine"), *[c for c in df.columns if c not in (key, size)])


def _forest(linked: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric boolean matrix, as edges to the least id of each tree's root."""
    left = np.ones(len(ids), dtype=bool)
    a, b = [], []
    for root in np.argsort(ids, kind="stable"):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            x = front.pop()
            for y in np.flatnonzero(linked[x] & left).tolist():
                left[y] = False
                a.append(int(ids[y]))
                b.append(int(ids[root]))
                front.append(y)
    return a, b


def _apart(i: int, j: int, mine: np.ndarray) -> np.ndarray:
    """Which pairs a block against a block decides: all of a block with itself, else those between the two."""
    m = np.ones((len(mine), len(mine)), dtype=bool) if i == j else mine[:, None] != mine[None, :]
    np.fill_diagonal(m, False)
    return m


def _bucket_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for g in sorted_groups(batches, 3):
        sid = g.column(4).to_numpy(zero_copy_only=False)
        sig = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in g.column(5)])
        alike = np.zeros((len(sid), len(sid)), dtype=bool)
        for x in range(len(sid)):
            alike[x] = (sig == sig[x]).mean(axis=1) >= least
        alike &= _apart(g.column(1)[0].as_py(), g.column(2)[0].as_py(), g.column(3).to_numpy(zero_copy_only=False))
        a, b = _forest(alike, sid)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a product of incidence matrices by slabs of columns."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for s in range(0, len(values), 8192):
        lo, hi = np.searchsorted(place, (s, s + 8192))
        m = np.zeros((len(sets), min(8192, len(values) - s)), dtype=np.float32)
        m[row[lo:hi], place[lo:hi] - s] = 1
        out += m @ m.T
    return out


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of verified links, and for every text a row ``(sid, sid, links)``."""
    for g in sorted_groups(batches, 3):
        sid = g.column(4).to_numpy(zero_copy_only=False)
        copies = g.column(5).to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column(6)]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = _intersections(sets).astype(np.float64)
        linked = both / (size[:, None] + size[None, :] - both) >= threshold
        linked &= _apart(g.column(1)[0].as_py(), g.column(2)[0].as_py(), g.column(3).to_numpy(zero_copy_only=False))
        a, b = _forest(linked, sid)
        n = linked @ copies
        cols = [pa.array([*a, *sid.tolist()], pa.int64()), pa.array([*b, *sid.tolist()], pa.int64()), pa.array([*[0] * len(a), *n.tolist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["a", "b", "links"])


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """``(doc_id, th, class_doc, class_sid, sid, links)`` of every row of ``docs``."""
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(_signed(docs, n, bands, rows), "signatures")
    texts = signed.where("sid is not null")
    nodes = texts.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "th")).alias("rep"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "texts")
    # buckets of two texts or more; those with the same members are one
    keyed = texts.dropDuplicates(["sid"]).select("sid", F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(
        F.count("*").alias("m"), F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "sid")).alias("y")
    )
    sizes = sizes.where("m > 1").groupBy("m", "lo", "hi", "x", "y").agg(F.min("bucket").alias("bucket"))
    members = keyed.join(sizes.select("bucket", "m"), "bucket").select("bucket", "m", "sid")
    members = members.join(texts.select("sid", "sig").dropDuplicates(["sid"]), "sid").select("bucket", "m", "sid", "sig")
    dealt = _blocks(members, "bucket", "m", BUCKET_BLOCK)
    edges = (
        dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(lambda it: _bucket_links(it, threshold - SLACK), "a long, b long")
    )
    groups = materialize(connected_components(materialize(edges, "likely"), "likely"), "groups")
    # full sets of the texts in candidate groups, one document for each text
    counts = groups.groupBy("component").agg(F.count("*").alias("m"))
    picked = groups.withColumnRenamed("node", "sid").join(counts, "component").join(nodes, "sid")
    key = lambda c: [c.isNotNull().alias("known"), F.coalesce(c.cast("string"), F.lit("")).alias("key")]
    picked = picked.select("component", "m", "sid", "copies", *key(F.col("rep.doc_id")), F.col("rep.th").alias("th"))

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        g = [ngram_set(t.as_py(), n).tobytes() for t in b.column(4)]
        return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(g, pa.binary())], ["component", "m", "sid", "copies", "grams"])

    d = docs.select(*key(F.col("doc_id")), F.xxhash64("text").alias("th"), "text")
    found = d.join(picked, ["known", "key", "th"]).dropDuplicates(["known", "key", "th"])  # rows that stand there twice, dealt as the join dealt them
    found = found.select("component", "m", "sid", "copies", text_or_empty().alias("text"))
    full = materialize(map_arrow(found, sets, "component long, m long, sid long, copies long, grams binary"), "sets")
    dealt = _blocks(full.select("component", "m", "sid", "copies", "grams"), "component", "m", SET_BLOCK)
    checked = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(lambda it: _verified(it, threshold), "a long, b long, links long")
    checked = materialize(checked, "verified")
    links = checked.where("a = b").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("others"))
    classes = connected_components(checked.select("a", "b"), "classes")
    by_text = (
        nodes.join(classes.withColumnRenamed("node", "sid"), "sid", "left")
        .join(links, "sid", "left")
        .withColumn("component", F.coalesce("component", "sid"))
    )
    reps = by_text.groupBy("component").agg(F.min(F.struct("rep", "sid")).alias("first"))
    by_text = by_text.join(reps, "component").select(
        "sid",
        F.col("first.rep.doc_id").alias("class_doc"),
        F.col("first.rep.th").alias("class_th"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    return signed.select("doc_id", "th", "sid").join(by_text, "sid", "left")


def near_duplicates(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """``(doc_id, class_id, links)``, one row for each row of ``docs(doc_id, text)``.

    A class is a component of the links; its id is its least doc_id. ``links`` counts the other documents whose
    n-gram sets have a Jaccard similarity of ``threshold`` or more, copies included.
    """
    c = _classes(docs, n, threshold, recall)
    alone = F.col("sid").isNull()
    return c.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_doc")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )


def drop_near_duplicates(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """``docs`` with one document of each class, the one of the least id; texts without words all stay.

    Columns of any name come through with their values; an empty table gives an empty one.
    """
    c = _classes(docs, n, threshold, recall).where("sid is not null")
    kept = c.where(F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("th") == F.col("class_th")))
    drop = c.select("doc_id", "th").distinct().join(
        kept.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).distinct(), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left_anti"
    )
    drop = materialize(drop.select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th")), "dropped")
    th, once = free_names(docs, "th", "once")
    d_id, d_th = free_names(docs, "d_id", "d_th")
    d = docs.withColumn(th, F.xxhash64("text"))
    drop = drop.select(F.col("d_id").alias(d_id), F.col("d_th").alias(d_th))
    left = d.join(drop, d["doc_id"].eqNullSafe(drop[d_id]) & (d[th] == drop[d_th]), "left_anti")
    blank = F.trim(F.regexp_replace(text_or_empty(), r"\s+", " ")) == ""
    # repeated rows of one document are copies too: one of them stays
    left = left.withColumn(once, F.when(blank, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long")))
    return left.dropDuplicates(["doc_id", th, once]).select(*docs.columns)
