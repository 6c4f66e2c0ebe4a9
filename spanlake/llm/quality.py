"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every document gives one short vector of statistics (shares of kinds of bytes, repetition of words, word pairs
and lines, lengths), each put through a log so that the class densities are near normal. Spark sums counts, first
and second moments of all labelled rows by class; the driver holds those few sums alone. Class covariances are
shrunk towards the pooled one and its diagonal; their Cholesky factors are kept and sent to the workers, and a
score is the logistic of the difference of Mahalanobis log densities.

Defined results: null and empty texts have the statistics of an empty text and so one common score; labels that
are null, neither 0 nor 1, or given more than once for an id with different values do not teach (repeats of one
value teach once); a row with a null doc_id is scored and does not teach; with a class missing every score is the
share of label 1 (0.5 without labels); repeated documents are scored each; a text of any length is read whole; an empty
table gives an empty result; extra columns are ignored, whatever their names (``keep_quality`` hands them on).
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, materialize, text_or_empty

THRESHOLD = 0.3
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.05
FOLDS = 5
_KINDS = np.full(256, 7, dtype=np.int64)  # other ASCII
_KINDS[list(range(97, 123))] = 0
_KINDS[list(range(128, 256))] = 0
_KINDS[list(range(65, 91))] = 1
_KINDS[list(range(48, 58))] = 2
_KINDS[[32, 9, 10, 11, 12, 13]] = 3
_KINDS[list(b".,;:'\"-()")] = 4
_KINDS[list(b"!?")] = 5
_KINDS[list(b"#$%&*@^~|<>=+_\\/{}[]`")] = 6
N_STATS = 14


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text."""
    raw = text.encode("utf-8")
    kinds = np.bincount(_KINDS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=8)
    size = len(raw) + 1.0
    words = text.split()
    n = len(words)
    counts = Counter(words)
    repeats = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    share = lambda x, of: float(np.log((x + 0.5) / (of + 1.0)))
    return [
        share(kinds[1], size),
        share(kinds[2], size),
        share(kinds[3], size),
        share(kinds[4], size),
        share(kinds[5], size),
        share(kinds[6], size),
        share(kinds[7], size),
        share(n - len(counts), n),
        share(max(counts.values(), default=0), n),
        share(repeats, n),
        share(max(0, n - 1 - pairs), n),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n)),
        float(np.log((kinds[0] + kinds[1] + 1.0) / (n + 1.0))),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x array<double>)`` of every row of ``docs(doc_id, text)``."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t.as_py()) for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), run, f"doc_id {kind}, x array<double>")


def training_labels(labels: DataFrame, name: str, fold: int = 0) -> DataFrame:
    """One row ``(doc_id, y)`` for each id whose labels agree, without the held-out fold."""
    lab = labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != fold))
    lab = lab.groupBy("doc_id").agg(F.min(name).alias("y"), F.max(name).alias("y2"))
    return lab.where("y = y2").select("doc_id", F.col("y").cast("int").alias("y"))


class Discriminant:
    """Two shrunk normal densities with cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL):
        n = {y: m[0] for y, m in moments.items()}
        self.prior = (n.get(1, 0) + 1.0) / (n.get(0, 0) + n.get(1, 0) + 2.0)
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        if min(n.get(0, 0), n.get(1, 0)) < 2:
            return
        mean = {y: s / k for y, (k, s, _) in moments.items()}
        cov = {y: ss / k - np.outer(mean[y], mean[y]) for y, (k, _, ss) in moments.items()}
        both = sum(n[y] * cov[y] for y in (0, 1)) / (n[0] + n[1])
        for y in (0, 1):
            c = (1 - pooled) * cov[y] + pooled * both
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(both)) + 1e-6 * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.parts.append((mean[y], np.linalg.inv(low), float(np.log(np.diag(low)).sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for sign, (mean, inverse, log_det) in zip((-1, 1), self.parts, strict=False):
            d = (x - mean) @ inverse.T
            z += sign * (-0.5 * np.einsum("ij,ij->i", d, d) - log_det)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def class_moments(stats: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products by class; a row for each class and pair of statistics reaches the driver."""
    d = N_STATS
    one = stats.where("doc_id is not null").groupBy("doc_id").agg(F.min("x").alias("x")).join(labels, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in np.unique(y).tolist():
                sums[c] = sums.get(c, 0) + x[y == c].T @ x[y == c]
        for c, m in sums.items():
            k = np.arange(m.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, c, np.int32)), pa.array(k), pa.array(m.ravel())], ["y", "k", "v"])

    rows = one.select("y", "x").mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.y, np.zeros((d + 1) ** 2))[r.k] = r.v
    return {y: (m[0], m.reshape(d + 1, d + 1)[0, 1:], m.reshape(d + 1, d + 1)[1:, 1:]) for y, m in out.items()}


def _scored(stats: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)  # two means and two small factors

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_STATS)
        s = shared.value.scores(x)
        cols = [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return map_arrow(stats.select("doc_id", "x"), run, f"doc_id {kind}, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; 1 is good."""
    stats = materialize(document_statistics(docs), "statistics")
    model = Discriminant(class_moments(stats, training_labels(labels, "quality")))
    s = _scored(stats, model, threshold)
    return s.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns.

    It learns on the labelled rows of ``docs``. The statistics of a row are computed once more to judge it where it
    stands, so that its text is not shuffled.
    """
    stats = document_statistics(docs if all_docs is None else all_docs)
    train = training_labels(labels, "quality")
    model = docs.sparkSession.sparkContext.broadcast(Discriminant(class_moments(stats, train)))
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t or "") for t in b.column(at).to_pylist()])
        return b.filter(pa.array(model.value.scores(x) >= threshold))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, run, fields)
