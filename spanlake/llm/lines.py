"""Line dedup: lines that several documents hold stay in the document of the smallest id alone.

1. Each document gives off the 128-bit hashes (BLAKE2b) of its distinct line keys, which are written to a table once.
2. An aggregate by hash finds the keys of at least two documents, with their count and smallest doc_id.
3. These keys are dealt to shards by the leading bits of their hash. A shard becomes one row: a minimal perfect hash
   (bit levels; a key takes the first level where no other key of the shard meets it, and its place is the rank of its
   bit) over three flat arrays, the fingerprints, the counts and the smallest doc_ids.
4. Documents' hashes probe the arrays of their shard. A shard that many probes ask, as it holds the line of a third of
   all documents, stands in as many copies as keep a copy near ``PROBES`` probes, and probes are dealt over the copies.
5. The hits of a document are gathered and its lines filtered.

No line travels: what is shuffled is 24 bytes for each distinct key of a document, the arrays, and the texts once, to
meet their hits. Nothing but the number of keys comes to the driver. One small table is broadcast, a row of a few bytes
for each shard, of which there are at most ``2 ** MAX_BITS``.

A key that is in no array still finds a place there; it is told apart by the 64-bit fingerprint, so that a line which
stands in one document only is dropped with a chance of 2**-64 a line.

Defined results: doc_id is an integer, and rows of one doc_id are one document; rows without a doc_id keep their lines
and count for nothing; null and empty texts are one empty line; very long texts are read whole; repeated rows fare
alike; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import on_workers
from .common import map_arrow, materialize, sorted_groups, text_or_empty

MIN_CHARS = 10
SHARD_KEYS = 1 << 19
PROBES = 1 << 20
MAX_BITS = 18
GAMMA = 2
SPACE = b" \t\n\x0b\x0c\r"


def key_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of a line's key: white space at both ends goes, A-Z become small; none for keys under ``min_chars``."""
    k = line.strip(SPACE).lower()  # of bytes: only A-Z change
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode()) < min_chars):
        return None
    return hashlib.blake2b(k, digest_size=16).digest()


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for by, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> np.uint64(by))) + b) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Places 0 to n - 1 for n distinct pairs of words; other pairs get some place, or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, base = levels, [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int32) + np.int32(base - 1))
            base += int(bits.sum())
        self.n = base

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(a):
            m = max(64, GAMMA * len(a))
            at = (_mixed(a, b, len(levels)) % np.uint64(m)).astype(np.int64)
            met = np.bincount(at, minlength=m)
            levels.append(met == 1)
            left = met[at] != 1
            a, b = a[left], b[left]
        return cls(levels)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mixed(a[left], b[left], k) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *[len(x) for x in self.levels]], dtype="<i8")
        return head.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash, and where it ends."""
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        end, levels = 8 * (n + 1), []
        for size in np.frombuffer(raw, "<i8", n, 8).tolist():
            width = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, end), count=size).astype(bool))
            end += width
        return cls(levels), end


class Shard:
    """A perfect hash over fingerprints, counts and first documents, each in the order of places."""

    def __init__(self, raw: bytes):
        self.hash, at = PerfectHash.unpack(raw)
        n = self.hash.n
        self.fingerprint = np.frombuffer(raw, "<u8", n, at)
        self.count = np.frombuffer(raw, "<u4", n, at + 8 * n)
        self.first = np.frombuffer(raw, "<i8", n, at + 12 * n)

    @staticmethod
    def pack(a: np.ndarray, b: np.ndarray, count: np.ndarray, first: np.ndarray) -> bytes:
        h = PerfectHash.build(a, b)
        order = np.argsort(h.places(a, b))
        return h.pack() + b[order].astype("<u8").tobytes() + np.minimum(count[order], 2**32 - 1).astype("<u4").tobytes() + first[order].astype("<i8").tobytes()

    def drops(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of each probe, whether its line stands in several documents and first in another one."""
        p = self.hash.places(a, b)
        out = np.zeros(len(a), dtype=bool)
        found = np.flatnonzero(p >= 0)
        q = p[found]
        out[found] = (self.fingerprint[q] == b[found]) & (self.count[q] > 1) & (self.first[q] < doc[found])
        return out


def _words(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).view(np.uint64)


def line_hashes(docs: DataFrame, doc: Column, text: Column, min_chars: int) -> DataFrame:
    """``(doc, a, b)``: the two words of the hash of each distinct key of a row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs_of, raw = batch.column(0).to_numpy(), []
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            found = {h for line in t.split(b"\n") if (h := key_hash(line, min_chars)) is not None}
            raw += sorted(found)
            n[i] = len(found)
        words = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
        cols = [np.repeat(docs_of, n), words[:, 0].copy(), words[:, 1].copy()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc", "a", "b"])

    rows = docs.select(doc.alias("doc"), text.alias("text")).where("doc is not null")
    return map_arrow(rows, run, "doc long, a long, b long")


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("a", 64 - bits).cast("int")


def build_arrays(shared: DataFrame, bits: int) -> DataFrame:
    """``(shard, probes, arrays)``: a row for each shard of ``shared(a, b, n, first)``."""
    on_workers(shared.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 1):
            n = g.column("n").to_numpy()
            raw = Shard.pack(_words(g.column("a")), _words(g.column("b")), n, g.column("first").to_numpy())
            yield pa.RecordBatch.from_arrays([g.column(0).slice(0, 1), pa.array([int(n.sum())]), pa.array([raw], pa.binary())], ["shard", "probes", "arrays"])

    rows = shared.select(_shard(bits).alias("shard"), "a", "b", "n", "first").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "shard int, probes long, arrays binary")


def probe_arrays(hashes: DataFrame, arrays: DataFrame, bits: int, everywhere: int, probes: int = PROBES) -> DataFrame:
    """``(doc, key)`` of the lines to drop. ``everywhere``: probes of all shards together."""
    on_workers(hashes.sparkSession)
    copies = (1 + (F.col("probes") + F.lit(everywhere // (1 << bits))) / probes).cast("int").alias("copies")
    loads = F.broadcast(arrays.select("shard", copies))  # a few bytes a shard, at most 2 ** MAX_BITS
    none = F.lit(None)
    asks = hashes.withColumn("shard", _shard(bits)).join(loads, "shard")
    asks = asks.select("shard", F.pmod(F.xxhash64("doc", "a"), "copies").cast("int").alias("copy"), F.lit(1).alias("ask"), "doc", "a", "b", none.cast("binary").alias("arrays"))
    gives = arrays.select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.lit(0).alias("ask"), *[F.lit(0).cast("long").alias(c) for c in ("doc", "a", "b")], "arrays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ask = batch.column("ask").to_numpy()
            doc, a, b = batch.column("doc").to_numpy(), _words(batch.column("a")), _words(batch.column("b"))
            cuts = [0, *np.flatnonzero(ask == 0).tolist(), len(ask)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if ask[s] == 0:
                    shard, s = Shard(batch.column("arrays")[s].as_py()), s + 1
                hit = s + np.flatnonzero(shard.drops(a[s:e], b[s:e], doc[s:e]))
                if len(hit):
                    raw = np.stack([a[hit], b[hit]], axis=1).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())], ["doc", "key"])

    both = gives.unionByName(asks).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "ask")
    return both.mapInArrow(run, "doc long, key binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """``(<id_col>, n_lines, n_dropped, kept)``: the text without the lines that an earlier document holds too.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least ``min_chars`` code points
    count. ``shard_keys`` and ``probes`` size the shards and their copies, and change no result.
    """
    doc, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    hashes = materialize(line_hashes(docs, doc, text, min_chars), "line-hashes")
    seen = Observation()
    by_key = hashes.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    by_key = by_key.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("first") < F.col("last")).cast("int")), F.lit(0)).alias("keys"))
    shared = materialize(by_key.where("first < last").drop("last"), "line-keys")
    told = seen.get
    bits = min(MAX_BITS, max(1, (int(told["keys"]) // shard_keys).bit_length()))
    arrays = materialize(build_arrays(shared, bits), "line-arrays")
    hits = probe_arrays(hashes, arrays, bits, int(told["n"]), probes)
    lost = hits.groupBy("doc").agg(F.collect_list("key").alias("lost"))
    rows = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), text.alias("text")).join(lost, "doc", "left").select("id", "text", "lost")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, n, dropped = [], np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        for i, (t, keys) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            lines = t.split(b"\n")
            n[i] = len(lines)
            if keys:
                gone = set(keys)
                lines = [x for x in lines if key_hash(x, min_chars) not in gone]
                t = b"\n".join(lines)
            dropped[i] = n[i] - len(lines)
            kept.append(t)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(dropped), pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_lines", "n_dropped", "kept"])

    return map_arrow(rows, run, f"`{id_col}` {id_type}, n_lines long, n_dropped long, kept string")


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, i, string_split(t, chr(10))[i] as line, len(string_split(t, chr(10))) as n_lines from (select *, unnest(generate_series(1, len(string_split(t, chr(10))))) as i from d)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as owner from k where length(key) >= 10 and doc_id is not null group by key having count(distinct doc_id) >= 2),
m as (select k.*, coalesce(s.owner <> k.doc_id, false) as gone from k left join s using (key))
select doc_id, any_value(n_lines)::bigint as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id
"""
