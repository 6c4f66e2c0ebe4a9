"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are maximal runs of ``[0-9A-Za-z]`` and non-ASCII characters, A-Z lower-cased. An automaton over the words
of all items follows the words of a document and gives, at every word, the length of the longest run ending
there that also stands in some item. Every run of at least ``window`` words is hit; an item of fewer words is hit
only as a whole. Runs of words that no item holds are passed over without a step.

The items are the query set: they are cut into blocks of at most ``BLOCK_BYTES`` text by a hash of the item id,
and every document is read against every block. A block alone is ever held by the driver or a worker.

Defined results: a null text has no words; items without words are ignored; a null item_id reads as the empty
text; repeated items count once per id, and items of equal texts each; an empty benchmark leaves all documents clean;
repeated rows are separate; a null doc_id is kept as it is; a text of any length is read whole; an empty table gives an
empty result; extra columns are ignored or handed on, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, hold, map_arrow, materialize, text_or_empty

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_BYTES = 1 << 20
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """Normalised words as UTF-8; splitting bytes is safe as no byte of a longer character is below 128."""
    return text.encode("utf-8").translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.length, self.link, self.step = [0], [-1], [{}]
        seqs = []
        for name, words in items:
            if words:
                seqs.append((name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        self.least = min([window, *(len(s) for _, s in seqs)])
        for _, s in seqs:
            last = 0
            for c in s:
                last = self._add(last, c)
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, s in seqs:
            at, n = 0, 0
            for c in s:
                at, n = self.follow(at, n, c)
                if n >= window:
                    self.windows.setdefault(self.base(at), set()).add(name)
            if len(s) < window:
                self.short.setdefault(at, []).append((len(s), name))
        if self.short:  # the nearest state up the links, itself included, that ends a short item
            self.near = [-1] * len(self.length)
            for v in sorted(range(len(self.length)), key=self.length.__getitem__):
                self.near[v] = v if v in self.short else self.near[self.link[v]] if self.link[v] >= 0 else -1

    def _new(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def follow(self, at: int, n: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while at and c not in self.step[at]:
            at = self.link[at]
            n = self.length[at]
        to = self.step[at].get(c)
        return (0, 0) if to is None else (to, n + 1)

    def base(self, at: int) -> int:
        """The state of the last ``window`` words of a match that is at least as long."""
        while self.length[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def hits(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit word ranges, flat as start, end, start, end..., and the items behind them."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= self.least
        spans: list[int] = []
        items: set[str] = set()
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            at = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                at, n = self.follow(at, n, c)
                reach = 0
                if n >= self.window:
                    items |= self.windows[self.base(at)]
                    reach = n
                if self.short:
                    v = self.near[at]
                    while v >= 0:
                        for k, name in self.short[v]:
                            if k <= n:
                                items.add(name)
                                reach = max(reach, k)
                        up = self.link[v]
                        v = self.near[up] if up >= 0 else -1
                if reach:
                    s = i + 1 - reach
                    while spans and spans[-1] >= s:  # grow the last range, or swallow it
                        s = min(s, spans[-2])
                        del spans[-2:]
                    spans += [s, i + 1]
        return spans, items


_built: dict[tuple[str, int], ItemAutomaton] = {}


def _automaton(shared, window: int) -> ItemAutomaton:
    """The automaton of a broadcast block of items, built once a worker."""
    hold("decontaminate", _built.clear)
    name, items = shared.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = ItemAutomaton([(i, words_of(t)) for i, t in items], window)
    return _built[name, window]


def _merge(spans: list[int], more: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(spans[::2], spans[1::2], strict=True), *zip(more[::2], more[1::2], strict=True)]):
        if out and out[-1] >= s:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with three columns more, and their free names: the count of words, the hit word ranges (flat) and the
    item ids."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size * 5 // (block_bytes * 4)))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = free_names(docs, "words", "spans", "items")
    out = docs.withColumns(dict(zip(names, (F.lit(0).cast("long"), F.array().cast("array<int>"), F.array().cast("array<string>")), strict=True)))
    at = docs.columns.index("text")
    n_cols = len(docs.columns)
    for k in range(blocks):
        rows = [(r.item, r.text) for r in items.where(F.col("block") == k).select("item", "text").collect()]
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))

        def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            auto = _automaton(shared, window)
            n, spans, found = [], [], []
            for text, s0, i0 in zip(b.column(at), b.column(n_cols + 1), b.column(n_cols + 2), strict=True):
                words = words_of(text.as_py() or "")
                s, i = auto.hits(words)
                n.append(len(words))
                spans.append(_merge(s0.as_py(), s) if len(s0) else s)
                found.append(sorted({*i0.as_py(), *i}) if i or len(i0) else [])
            cols = [*b.columns[:n_cols], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, [*b.schema.names[:n_cols], *names])

        out = map_arrow(out, run, f"{fields}, {names[0]} long, {names[1]} array<int>, {names[2]} array<string>")
        if k % 2 and k + 1 < blocks:
            out = materialize(out, "hits")
    return out, names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row for each row of ``docs``."""
    h, (words, spans, items) = with_hits(docs.select("doc_id", "text"), benchmark, window)
    pairs = F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda i: F.get(spans, 2 * i + 1) - F.get(spans, 2 * i))
    n_hit = F.when(F.size(spans) > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return h.select(
        "doc_id",
        F.col(words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without the hit spans; documents covered beyond ``max_coverage`` of their words go altogether.

    A span is cut from the first letter of its first word to the last letter of its last word. Documents without
    hits come back untouched; ``n_chars``, where there is one, follows the text. Columns of any name come through with
    their values; an empty table gives an empty one.
    """
    h, _ = with_hits(docs, benchmark, window)
    n_cols = len(docs.columns)
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes, keep = [], [], []
        old = b.column(chars).to_pylist() if chars >= 0 else [None] * b.num_rows
        for text, n, spans, size in zip(b.column(at).to_pylist(), b.column(n_cols).to_pylist(), b.column(n_cols + 1).to_pylist(), old, strict=True):
            hit = sum(spans[1::2]) - sum(spans[::2])
            keep.append(not hit or hit <= max_coverage * n)
            if hit and keep[-1]:
                where = [m.span() for m in _TOKEN.finditer(text)]
                parts, last = [], 0
                for s, e in zip(spans[::2], spans[1::2], strict=True):
                    parts.append(text[last : where[s][0]])
                    last = where[e - 1][1]
                text = "".join([*parts, text[last:]])
                size = len(text)
            texts.append(text)
            sizes.append(size)
        cols = list(b.columns[:n_cols])
        cols[at] = pa.array(texts, b.schema.field(at).type)
        if chars >= 0:
            cols[chars] = pa.array(sizes, b.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(cols, b.schema.names[:n_cols]).filter(pa.array(keep))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(h, run, fields)


OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
n as (select item, least(10, len(ws)) k, ws from b where len(ws) > 0),
bw as (select distinct item, k, array_to_string(ws[i:i + k - 1], ' ') win from (select item, k, ws, unnest(range(1, len(ws) - k + 2)) i from n)),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') win
       from (select doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) i from w, (select distinct k from n))),
hit as (select dw.doc_id, dw.k, dw.i, item from dw join bw on dw.win = bw.win and dw.k = bw.k),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, k, i from hit)) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from hit) group by 1)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join pos using (doc_id) left join its using (doc_id)
"""
