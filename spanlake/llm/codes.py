"""Vector code compression: product codes by Lloyd rounds over cover trees.

Vectors become integers and are cut into ``PARTS`` parts. Each partition of the scan packs its vectors into blocks of at
most ``BLOCK`` and builds one cover tree for each part of a block: a node of level L holds points within 2**L of its
centre, its children's centres are more than 2**(L - 1) apart and cover it within 2**(L - 1), and the first child has the
centre of the node. Points stand in the order of the tree, so that a node is a run of them and cumulative sums
give the sum of any node. The blocks are written to a table once.

A round sends the codebooks (at most ``ENTRIES`` vectors) to the blocks. A node whose centre is nearer to its best
entry than to any other by more than twice the node's radius is assigned whole, and adds its sum; other nodes
descend, and only the points of ambiguous leaves are compared one by one. Distances are integers and exact; the triangle
inequality is asked with a margin above the error of the square roots. What comes to the driver is one row for each
component of the codebooks.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinity are dropped, and so are vectors of
another length than the kept one of the smallest vec_id; null vec_ids come last, and rows of one vec_id by their vectors;
under ``entries`` vectors make so many entries; a length that four does not divide is cut as evenly as can be;
components of 2**16 and more raise an error, as squared distances would not fit; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import on_workers
from .common import materialize, release_memory

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 1024
LEAF = 8
SALTS = 64
LARGEST = 1 << 26


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; as floats where those hold every term."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * top * top * max(1, a.shape[1]) < 1 << 53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


class CoverTree:
    """``order`` of the points given, ``points`` in it, and nodes level by level: runs ``lo`` to ``hi`` whose first point is
    the centre, squared radius ``r2``, children ``kid0`` to ``kid1``."""

    def __init__(self, order: np.ndarray, points: np.ndarray, nodes: np.ndarray):
        self.order, self.points = order, points
        self.lo, self.hi, self.r2, self.kid0, self.kid1 = nodes

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        d = squared(points, points)
        members, r2, kids = [np.arange(len(points))], [], []
        at = 0
        while at < len(members):
            m = members[at]
            near = d[m[0], m].copy()
            top = int(near.max())
            r2.append(top)
            parts = []
            if len(m) > leaf and top:
                level = 0  # the least whose balls hold the node
                while 4**level < top:
                    level += 1
                cover = 4 ** (level - 1) if level else 0
                owner, centres = np.zeros(len(m), dtype=np.int64), [0]
                while near[f := int(near.argmax())] > cover:
                    to = d[m[f], m]
                    closer = to < near
                    owner[closer] = len(centres)
                    near[closer] = to[closer]
                    centres.append(f)
                by_owner = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[by_owner], np.arange(len(centres) + 1))
                for k, c in enumerate(centres):
                    own = by_owner[cuts[k] : cuts[k + 1]]
                    parts.append(np.concatenate([m[[c]], m[own[own != c]]]))
            kids.append((len(members), len(members) + len(parts)))
            members += parts
            at += 1
        size, lo = np.array([len(m) for m in members]), np.zeros(len(members), dtype=np.int64)
        order = np.zeros(len(points), dtype=np.int64)
        for k, (a, b) in enumerate(kids):
            if a < b:
                lo[a:b] = lo[k] + np.concatenate([[0], np.cumsum(size[a : b - 1])])
            else:
                order[lo[k] : lo[k] + size[k]] = members[k]
        kid = np.array(kids, dtype=np.int64).T
        return cls(order, points[order], np.array([lo, lo + size, r2, kid[0], kid[1]], dtype=np.int64))

    def pack(self) -> list[bytes]:
        nodes = np.array([self.lo, self.hi, self.r2, self.kid0, self.kid1])
        return [self.order.astype("<i4").tobytes(), self.points.astype("<i4").tobytes(), nodes.astype("<i8").tobytes()]

    @classmethod
    def unpack(cls, raw: list[bytes]) -> CoverTree:
        order = np.frombuffer(raw[0], "<i4").astype(np.int64)
        return cls(order, np.frombuffer(raw[1], "<i4").astype(np.int64).reshape(len(order), -1), np.frombuffer(raw[2], "<i8").reshape(5, -1))

    def assign(self, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
        """Runs ``(lo, hi, entry)`` that cover all points, and how many points were compared with the entries."""
        rows = np.zeros((len(self.points), len(book)))
        known = np.zeros(len(self.points), dtype=bool)

        def compare(at: np.ndarray) -> None:
            new = np.unique(at[~known[at]])
            if len(new):
                rows[new] = squared(self.points[new], book)
                known[new] = True

        out, nodes = [], np.zeros(min(1, len(self.lo)), dtype=np.int64)
        while len(nodes):
            lo, hi, r2 = self.lo[nodes], self.hi[nodes], self.r2[nodes]
            compare(lo)
            d = rows[lo]
            best = d.argmin(axis=1)
            i = np.arange(len(nodes))
            least = d[i, best]
            d[i, best] = np.inf
            second = d.min(axis=1)
            sure = (r2 == 0) | ((np.sqrt(least) + 2 * np.sqrt(r2)) * (1 + 1e-9) < np.sqrt(second))
            out.append((lo[sure], hi[sure], best[sure]))
            kid0, kid1 = self.kid0[nodes], self.kid1[nodes]
            leaf = ~sure & (kid0 == kid1)
            if leaf.any():
                at = _runs(lo[leaf], hi[leaf])
                compare(at)
                out.append((at, at + 1, rows[at].argmin(axis=1)))
            down = ~sure & (kid0 < kid1)
            nodes = _runs(kid0[down], kid1[down])
        return out, int(known.sum())


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the runs, one run after another."""
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _edges(dim: int) -> list[int]:
    return [k * dim // PARTS for k in range(PARTS + 1)]


def build_blocks(kept: DataFrame, dim: int, id_type: str, block: int = BLOCK) -> DataFrame:
    """``(ids, labels, trees)``: a row for each block of ``kept(id, label, v)``."""
    on_workers(kept.sparkSession)
    edges = _edges(dim)

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        v = pa.concat_arrays([c.flatten() for c in t.column("v").chunks]).to_numpy().reshape(-1, dim)
        if np.abs(v).max() >= LARGEST:
            raise ValueError(f"a component is not under {LARGEST // SCALE}")
        trees = [x for a, b in zip(edges, edges[1:], strict=False) for x in CoverTree.build(v[:, a:b]).pack()]
        release_memory()
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.concat_arrays(t.column(c).chunks))
        return pa.RecordBatch.from_arrays([whole("id"), whole("label"), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, block - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == block:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return kept.select("id", "label", "v").mapInArrow(run, f"ids array<{id_type}>, labels array<string>, trees array<binary>")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[CoverTree]]]:
    for b in batches:
        for i in range(b.num_rows):
            raw = b.column("trees")[i].as_py()
            yield b.slice(i, 1), [CoverTree.unpack(raw[3 * p : 3 * p + 3]) for p in range(PARTS)]


def part_sums(blocks: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part the sums and counts of the vectors that its entries get."""
    offsets, size = [], 0
    for book in books:
        offsets.append(size)
        size += len(book) * (book.shape[1] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for _, trees in _trees(batches):
            for tree, book, at in zip(trees, books, offsets, strict=True):
                upto = np.concatenate([np.zeros((1, book.shape[1]), dtype=np.int64), np.cumsum(tree.points, axis=0)])
                cells = total[at : at + len(book) * (book.shape[1] + 1)].reshape(len(book), -1)
                for lo, hi, entry in tree.assign(book)[0]:
                    np.add.at(cells, entry, np.concatenate([upto[hi] - upto[lo], (hi - lo)[:, None]], axis=1))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "total"])

    got = blocks.mapInArrow(run, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()  # a row for a component of the codebooks
    total = np.zeros(size, dtype=np.int64)
    for r in got:
        total[r.cell] = r.total
    cells = [total[at : at + len(b) * (b.shape[1] + 1)].reshape(len(b), -1) for b, at in zip(books, offsets, strict=True)]
    return [(c[:, :-1], c[:, -1]) for c in cells]


def _coded(blocks: DataFrame, books: list[np.ndarray], id_type: str) -> DataFrame:
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, trees in _trees(batches):
            n = len(trees[0].order)
            code, error = np.full(n, "", dtype=object), np.zeros(n, dtype=np.int64)
            for tree, book in zip(trees, books, strict=True):
                entry = np.zeros(n, dtype=np.int64)
                for lo, hi, e in tree.assign(book)[0]:
                    entry[_runs(lo, hi)] = np.repeat(e, hi - lo)
                error[tree.order] += ((tree.points - book[entry]) ** 2).sum(axis=1)
                code[tree.order] += digits[entry]
            yield pa.RecordBatch.from_arrays([b.column("ids").flatten(), b.column("labels").flatten(), pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {id_type}, label string, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """``(<id_col>, code, error, label_error, codebooks_sha256)`` of the kept vectors.

    ``code`` has two hex digits a part, ``error`` is the squared distance to the coded vector, ``label_error`` its sum over
    equal labels. ``block`` sizes the trees and changes no result.
    """
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"entries must be 1 to {ENTRIES}")
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    kept = vectors.where(x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), ints.alias("v"))
    id_type = vectors.schema[id_col].dataType.simpleString()
    ordered = lambda df, n: df.select("v").orderBy(df["id"].asc_nulls_last(), "v").limit(n).collect()
    dim = len(first[0].v) if (first := ordered(kept, 1)) else PARTS
    kept = kept.where(F.size("v") == dim)
    start = np.array([r.v for r in ordered(kept, entries)], dtype=np.int64).reshape(-1, dim)  # at most ENTRIES rows
    books = [start[:, a:b] for a, b in zip(_edges(dim), _edges(dim)[1:], strict=False)]
    blocks = materialize(build_blocks(kept, dim, id_type, block), "vector-blocks")
    for _ in range(rounds if len(start) else 0):
        sums = part_sums(blocks, books)
        books = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], old) for old, (s, n) in zip(books, sums, strict=True)]
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    coded = materialize(_coded(blocks, books, id_type), "vector-codes")
    known, name = F.col("label").isNotNull().alias("known"), F.coalesce("label", F.lit("")).alias("name")
    by_label = coded.groupBy(known, name).agg(F.sum("error").alias("label_error"))
    # a label of a third of all rows is met in as many tasks as there are salts
    by_label = by_label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = coded.select("id", "code", "error", known, name, F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int").alias("salt")).join(by_label, ["known", "name", "salt"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    near = "list_inner_product(w, w) - 2 * list_inner_product(w, c) + list_inner_product(c, c)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} as materialized (select vec_id, part, min({{'d': ({near})::bigint, 'e': entry}}) as m from p join c{r} using (part) group by all)")
        if r < ROUNDS:
            steps.append(
                f"m{r} as materialized (select part, entry, list(f order by i) as c from (select part, entry, i, floor(sum(x) / count(*)) as f from "
                f"(select part, m.e as entry, unnest(w) as x, unnest(generate_series(1, len(w))) as i from a{r} join p using (vec_id, part)) group by all) group by all)"
            )
            steps.append(f"c{r + 1} as materialized (select part, entry, coalesce(n.c, o.c) as c from c{r} o left join m{r} n using (part, entry))")
    return f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part, v[len(v) * part // {PARTS} + 1 : len(v) * (part + 1) // {PARTS}] as w from k, range({PARTS}) r(part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, w as c from p qualify entry < {ENTRIES}),
{(", " + chr(10)).join(steps)},
b as (select sha256(string_agg(t, ',' order by part, entry)) as h from (select part, entry, array_to_string(list_transform(c, lambda x: x::bigint::varchar), ',') as t from c{ROUNDS})),
e as (select vec_id, string_agg(printf('%02x', m.e), '' order by part) as code, sum(m.d)::bigint as error from a{ROUNDS} group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from e join k using (vec_id), b
"""


OP12_SQL = _sql()
