"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features say which hashed n-grams of characters (code points of the text in lower case, words marked at their ends) a
document holds. Document counts of every feature are summed by Spark over all labelled training rows and give the
log-count ratios; features with a ratio under ``MIN_RATIO`` carry nothing and are left out (on held-out rows keeping
them all is worse). A logistic regression over the ratio-scaled features is fitted on a sample of about ``SAMPLE_ROWS``
labelled rows, those with the least hashes of the id; a sampled row sends its features with a ratio only, whatever the
length of its text. Every whole text is scored.

Defined results: null and empty texts hold no n-gram and get one common score; a text of any length is read whole;
labels that are null, neither 0 nor 1, or contradict each other do not teach; a row with a null doc_id is scored and
does not teach; with a class missing every score is the share of label 1 (0.5 without labels); repeated documents are
scored each (equal texts get equal scores); an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, text_or_empty
from .quality import FOLDS, training_labels

GRAMS = (3, 4, 5)
BITS = 18
SMOOTH = 0.005  # documents of smoothing for each training document of label 1
MIN_RATIO = 1.5
SAMPLE_ROWS = 12_000
ROUNDS = 150
PENALTY = 1e-3
THRESHOLD = 0.5
_PRIME = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


def gram_buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram occurrence of a text; grams are of characters (code points)."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    b[(b >= 9) & (b <= 13)] = 32
    out = []
    for n in GRAMS:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        h = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            h ^= b[k : k + m]
            h *= _PRIME
        h ^= h >> np.uint32(15)
        h *= _MIX
        out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _labelled(docs: DataFrame, labels: DataFrame, name: str, share: float = 1.0) -> DataFrame:
    """``(y, text)`` of the training rows; a repeated id teaches with its least text."""
    lab = training_labels(labels, name)
    d = docs.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != 0)).select("doc_id", text_or_empty().alias("text"))
    if share < 1:
        picked = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")) < int((share - 0.5) * 2**64)
        lab, d = lab.where(picked), d.where(picked)
    return d.join(lab.hint("merge"), "doc_id")  # labels grow with the documents: never broadcast


def feature_ratios(docs: DataFrame, labels: DataFrame, name: str = "toxic") -> tuple[np.ndarray, float, float]:
    """Log-count ratios of all features, and the numbers of training rows of class 0 and 1.

    At most ``2 ** BITS`` rows come to the driver.
    """
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, size + 1), dtype=np.int64)
        seen = np.zeros(size, dtype=bool)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = gram_buckets(t)
                seen[k] = True
                c[y, np.flatnonzero(seen)] += 1
                c[y, size] += 1
                seen[k] = False
        k = np.flatnonzero(c.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c[0, k]), pa.array(c[1, k])], ["k", "c0", "c1"])

    rows = _labelled(docs, labels, name).select("y", "text").mapInArrow(run, "k int, c0 long, c1 long")
    sums = rows.groupBy("k").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()
    c = np.zeros((2, size + 1))
    c[0, sums["k"]], c[1, sums["k"]] = sums["c0"], sums["c1"]
    n0, n1 = c[0, size], c[1, size]
    if not n0 or not n1:
        return np.zeros(size), n0, n1
    n = n0 + n1
    a = SMOOTH * n1 + 5
    p = (c[1, :size] + a * n1 / n) / (n1 + a)
    q = (c[0, :size] + a * n0 / n) / (n0 + a)
    r = np.log(p / q)
    r[np.abs(r) < MIN_RATIO] = 0
    return r, n0, n1


def fit_logistic(indptr: np.ndarray, indices: np.ndarray, r: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the offset, by full-batch Adam from weights of zero."""
    n = max(1, len(y))
    used, place = np.unique(indices, return_inverse=True)
    ru, row = r[used], np.repeat(np.arange(len(y)), np.diff(indptr))
    w, b = np.zeros(len(used)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    weight = np.where(y > 0, max(1.0, ((len(y) - y.sum()) / max(1.0, y.sum())) ** 0.5), 1.0)  # the rarer class counts more
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=(w * ru)[place], minlength=len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        gw = np.bincount(place, weights=g[row], minlength=len(used)) * ru / n + penalty * w / max(1, len(used)) ** 0.5
        gb = g.mean() if len(y) else 0.0
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        k1, k2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / k1) / (np.sqrt(v / k2) + 1e-8)
        b -= 0.05 * (mb / k1) / (np.sqrt(vb / k2) + 1e-8)
    out = np.zeros(len(r))
    out[used] = w * ru
    return out, b


def train(docs: DataFrame, labels: DataFrame, name: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """``(weights, offset)`` of the classifier."""
    r, n0, n1 = feature_ratios(docs, labels, name)
    if not n0 or not n1:
        s = (n1 + 1) / (n0 + n1 + 2)
        return np.zeros(len(r)), float(np.log(s / (1 - s)))
    shared = docs.sparkSession.sparkContext.broadcast(r != 0)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column(1).to_pylist():
            k = gram_buckets(t)
            rows.append(np.unique(k[shared.value[k]]).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["y", "k"])

    some = _labelled(docs, labels, name, sample_rows / (n0 + n1)).select("y", "text")
    got = map_arrow(some, run, "y int, k binary").toPandas()
    k = [np.frombuffer(x, np.int32) for x in got["k"]]
    indptr = np.concatenate(([0], np.cumsum([len(x) for x in k]))).astype(np.int64)
    return fit_logistic(indptr, np.concatenate(k) if k else np.empty(0, np.int32), r, got["y"].to_numpy(np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; 1 is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # 2 ** BITS weights

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w, offset = shared.value
        s = np.empty(b.num_rows)
        for i, t in enumerate(b.column(1)):
            k = gram_buckets(t.as_py())
            s[i] = offset + w[np.unique(k[w[k] != 0])].sum()
        s = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_arrow(docs.select("doc_id", text_or_empty().alias("text")), run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
