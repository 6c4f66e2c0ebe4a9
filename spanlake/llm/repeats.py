"""Suffix-array dedup of repeated byte strings by prefix-free parsing.

A rolling hash over ``GRAM`` bytes triggers phrases: a position is a trigger if its hash is the first least one of
some window of ``min_len - GRAM + 1`` positions. So every string of ``min_len`` bytes holds a trigger, at a place
that its bytes alone decide, and equal strings are cut alike wherever they stand.

1. Triggers are shuffled by their gram. Grams that stand in one text only end there: nothing repeats across them.
2. The other triggers give off what lies before (the phrase's suffix, nearest byte first) and after (the parse that
   follows), as far as a string of ``min_len`` bytes can reach.
3. Inside a gram the phrase suffixes are sorted (the dictionary's suffix array) and so are the continuations (the
   parse's). Ranks down to a common prefix length, taken from the two arrays together, order the strings of
   ``min_len`` bytes as the corpus suffix array would, and number equal ones. Equal strings of a larger doc_id are
   removed.

The bytes around a gram are compared. The gram itself is known by a 64-bit hash of its bytes under a key that is drawn
anew for each run, so that no text can be made to meet another one; so are whole texts.

Triggers of a gram that has more than ``GROUP_ROWS`` are dealt by the gram and the half of what lies around it that a
string has whole: by what lies right before for strings that begin far before it, by what follows for the others. Where a task
still meets more than ``GROUP_ROWS`` different surroundings of one group, it gives off their strings of ``min_len`` bytes,
and the least doc_id of each is found by an aggregate over the strings and joined back.

Strings that repeat inside one batch are settled before the shuffle, so a passage of a third of all documents
leaves a row a batch. Rows of one text beyond its first doc_id are removed whole (128-bit hash of the text).

This is prefix-free parsing cut to the depth of ``min_len`` bytes and dealt by trigger: no dictionary or parse of the
whole corpus is written, as none of their suffixes is compared beyond that depth.

Defined results: doc_id is an integer; null and empty texts lose nothing; a null doc_id is the least; rows of one doc_id
never remove from each other; repeated rows fare alike; texts under ``min_len`` bytes lose nothing; a text of any length
is read whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import on_workers
from .common import hold, map_arrow, materialize, text_or_empty

MIN_LEN = 50
GRAM = 24
CHUNK_ROWS = 100_000
GROUP_ROWS = CHUNK_ROWS  # what a task holds before it settles
STRING_ROWS = 4096
SALTS = 16
CONTEXT_ROWS, CONTEXT_BYTES = 10_000, 32 << 20
_LEAST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    hold("repeats", _powers.clear)
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers.clear()
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def rolling_hash(raw: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of the ``gram`` bytes from every position."""
    up, down = _power_tables(len(raw))
    c = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=c[1:])
    h = (c[gram:] - c[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def triggers(raw: np.ndarray, min_len: int = MIN_LEN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(position, gram hash, dmin, dmax)``: a string of ``min_len`` bytes that starts d bytes before the position
    has it for its trigger iff ``dmin <= d <= dmax``."""
    if len(raw) < min_len:
        e = np.empty(0, np.int64)
        return e, np.empty(0, np.uint64), e, e
    h = rolling_hash(raw, gram)
    width = min_len - gram + 1
    at, span = np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        span += step
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)]))
    pos = at[cuts[:-1]].astype(np.int64)
    return pos, h[pos], pos - (cuts[1:] - 1), pos - cuts[:-1]


def _raw(text: pa.StringScalar) -> np.ndarray:
    buf = text.as_buffer()
    return np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)


def gram_hash(raw: np.ndarray, pos: np.ndarray, gram: int, key: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position, which nobody can foresee who does not know the key."""
    return _keyed(raw[pos[:, None] + np.arange(gram)], key)


def _keyed(rows: np.ndarray, key: int) -> np.ndarray:
    """A hash under the key of each row of bytes."""
    body = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    body[:, : rows.shape[1]] = rows
    h = np.full(len(rows), key, dtype=np.uint64)
    for word in body.view("<u8").T:
        h ^= word
        for by, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(by))) * np.uint64(m)
        h = (h ^ (h >> np.uint64(31))) + np.uint64(key | 1)
    return h.view(np.int64)


def keyed_triggers(raw: np.ndarray, min_len: int, gram: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``triggers`` with the keyed hash of their grams."""
    pos, _, dmin, dmax = triggers(raw, min_len, gram)
    return pos, gram_hash(raw, pos, gram, key), dmin, dmax


def _grams(min_len: int, gram: int, key: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(keyed_triggers(_raw(t), min_len, gram, key)[1], return_counts=True) for t in b.column(1)]
        th = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x, _ in found])
        g, n = (np.concatenate([x[i] for x in found]) for i in range(2))
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(th), pa.array(n.astype(np.int32))], ["g", "th", "n"])

    return run


_CONTEXT = "g long, before binary, after binary, la int, ra int, k long, th long, pos int, dmin int, dmax int, settled boolean"


def _halves(g: np.ndarray, before: np.ndarray, after: np.ndarray, dmin: np.ndarray, dmax: np.ndarray, secret: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers dealt by halves of their surroundings: ``(row, group, dmin, dmax)``, for each row that of the strings that
    hold half of the bytes before it and that of the rest, which hold half of those after it, where there are any."""
    reach = before.shape[1]
    half = reach // 2
    of = g.view(np.uint8).reshape(-1, 8)
    tag = lambda x: np.full((len(g), 1), x, np.uint8)
    far = _keyed(np.concatenate((of, tag(1), before[:, :half]), axis=1), secret)
    near = _keyed(np.concatenate((of, tag(2), after[:, : reach - half + 1]), axis=1), secret)
    row = np.arange(len(g))
    parts = [(row, far, np.maximum(dmin, half), dmax), (row, near, dmin, np.minimum(dmax, half - 1))]
    row, group, dmin, dmax = (np.concatenate(x) for x in zip(*parts, strict=True))
    some = dmin <= dmax
    return row[some], group[some], dmin[some], dmax[some]


def _contexts(min_len: int, gram: int, secret: int):
    reach = min_len - gram

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list[np.ndarray]] = [[] for _ in range(10)]
        for k, th, text, gs, many in zip(*b.columns, strict=True):
            raw = _raw(text)
            pos, h, dmin, dmax = keyed_triggers(raw, min_len, gram, secret)
            gs, many = (x.values.to_numpy(zero_copy_only=False) for x in (gs, many))
            keep = np.isin(h, np.concatenate((gs, many)) if len(many) else gs)
            pos, h, dmin, dmax = pos[keep], h[keep], dmin[keep], dmax[keep]
            if not len(pos):
                continue
            wide = np.concatenate((np.zeros(reach, np.uint8), raw, np.zeros(reach, np.uint8)))
            before = wide[pos[:, None] + np.arange(reach - 1, -1, -1)]
            after = wide[pos[:, None] + np.arange(reach + gram, 2 * reach + gram)]
            if len(many):
                heavy = np.isin(h, many)
                at, light = np.flatnonzero(heavy), np.flatnonzero(~heavy)
                row, group, lo, hi = _halves(h[at], before[at], after[at], dmin[at], dmax[at], secret)
                rows = np.concatenate((light, at[row]))
                h, dmin, dmax = (np.concatenate((x[light], y)) for x, y in ((h, group), (dmin, lo), (dmax, hi)))
                pos, before, after = pos[rows], before[rows], after[rows]
            n = len(pos)
            la, ra = np.minimum(reach, pos), np.minimum(reach, len(raw) - gram - pos)
            for c, v in zip(cols, (h, before, after, la, ra, np.full(n, k.as_py()), np.full(n, th.as_py()), pos, dmin, dmax), strict=True):
                c.append(v)
        if not cols[0]:
            return None
        g, before, after, la, ra, k, th, pos, dmin, dmax = (np.concatenate(c) for c in cols)
        # strings that an earlier document of this batch holds too are settled here
        key = np.concatenate((g.view(np.uint64).astype(">u8")[:, None].view(np.uint8), before, after, la.astype(np.uint8)[:, None], ra.astype(np.uint8)[:, None]), axis=1)
        key = np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel()
        order = np.lexsort((k, key))
        head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        first = k[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
        settled = np.zeros(len(g), dtype=bool)
        settled[order] = k[order] > first
        width = before.shape[1]
        none = np.zeros((1, width), np.uint8)
        before, after = (np.where(settled[:, None], none, x) for x in (before, after))
        fixed = lambda x: pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
        out = [pa.array(g), fixed(before), fixed(after), *(pa.array(x.astype(np.int32)) for x in (la, ra)), pa.array(k), pa.array(th), *(pa.array(x.astype(np.int32)) for x in (pos, dmin, dmax)), pa.array(settled)]
        return pa.RecordBatch.from_arrays(out, ["g", "before", "after", "la", "ra", "k", "th", "pos", "dmin", "dmax", "settled"])

    return run


def _strings(g: np.ndarray, before: np.ndarray, after: np.ndarray, k: np.ndarray, dmin: np.ndarray, dmax: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, d, string, settled)`` of every string of these triggers: its bytes around the group's gram, after the group
    and d. One of a smaller k here settles it."""
    sizes = dmax.astype(np.int64) - dmin + 1
    row = np.repeat(np.arange(len(g)), sizes)
    d = np.repeat(dmin.astype(np.int64), sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = before.shape[1]
    at = np.arange(width)[None, :]
    ring = np.concatenate((before[:, ::-1], after), axis=1)  # in the order of the text, without the gram
    body = ring[row[:, None], width - d[:, None] + at]
    key = np.concatenate((g[row].view(np.uint8).reshape(-1, 8), d.astype(np.uint8)[:, None], body), axis=1)
    of = np.unique(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    least = np.full(of.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, k[row])
    return row, d, key, k[row] > least[of]


def heavy_hits(rows: DataFrame) -> DataFrame:
    """``(k, th, pos, mask)`` of the strings ``(s, k, th, pos, mask)`` that one of a smaller k equals, and of those that are settled,
    whose s is empty; no task holds a string's rows."""
    live = rows.where("octet_length(s) > 0")
    least = live.groupBy("s").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").drop("most")
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = live.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["s", "salt"]).where("k > least")
    hits = found.select("k", "th", "pos", "mask").unionByName(rows.where("octet_length(s) = 0").drop("s"))
    return hits.groupBy("k", "th", "pos").agg(F.bit_or("mask").alias("mask"))


def _ranks(g: np.ndarray, body: np.ndarray) -> np.ndarray:
    """``r[d, i]``: a number for the first d bytes of row i within its g, equal iff g and those bytes are equal."""
    n, width = body.shape
    key = np.ascontiguousarray(np.concatenate((g.view(np.uint64).astype(">u8")[:, None].view(np.uint8), body), axis=1))
    order = np.argsort(key.view(f"S{width + 8}").ravel(), kind="stable")
    s = key[order]
    same = np.cumprod(s[1:] == s[:-1], axis=1, dtype=np.int8).sum(axis=1) - 8  # common prefix beyond g; -1 or less: another g
    out = np.empty((width + 1, n), dtype=np.int32)
    for d in range(width + 1):
        out[d, order] = np.concatenate(([0], np.cumsum(same < d)))
    return out


def _all_from(dmin: np.ndarray, dmax: np.ndarray) -> np.ndarray:
    return ((np.int64(1) << (dmax.astype(np.int64) + 1)) - (np.int64(1) << dmin.astype(np.int64))).astype(np.int64)


def _solve(rows: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Bits d of the strings of each row that a row of a smaller k holds too."""
    g, before, after, k, dmin, dmax = (np.concatenate(x) for x in zip(*rows, strict=True))
    left, right = _ranks(g, before), _ranks(g, after)
    width = before.shape[1]
    mask = np.zeros(len(g), dtype=np.int64)
    for d in range(width + 1):
        i = np.flatnonzero((dmin <= d) & (d <= dmax))
        if len(i) < 2:
            continue
        key = left[d, i].astype(np.int64) * (len(g) + 1) + right[width - d, i]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_key)) + 1))
        least = np.minimum.reduceat(k[i][order], starts)
        hit = k[i][order] > np.repeat(least, np.diff(np.concatenate((starts, [len(i)]))))
        mask[i[order[hit]]] |= np.int64(1) << np.int64(d)
    return mask


def _repeated(batches: Iterator[pa.RecordBatch], width: int, most: int = GROUP_ROWS) -> Iterator[pa.RecordBatch]:
    """``(k, th, pos, mask)`` of all strings that repeat, from context rows sorted by g, before, after and k.

    A row with the context of the row before it is settled at once; only distinct contexts are held, up to the
    end of a gram. Of a gram with more than ``most`` of them (and some of a batch) the strings themselves go out as ``s``.
    """
    held: list[tuple[np.ndarray, ...]] = []
    names: list[tuple[np.ndarray, ...]] = []
    size = 0
    prev = None
    split_g = None  # the gram whose strings go out
    opened, open_rows = 0, 0  # where the last gram begins in what is held, and its rows

    def give_off() -> Iterator[pa.RecordBatch]:
        """The strings of the rows held, all of one gram."""
        nonlocal held, names, size, opened, open_rows
        g, before, after, k, dmin, dmax = (np.concatenate(x) for x in zip(*held, strict=True))
        th, pos = (np.concatenate([x[i] for x in names]) for i in range(2))
        for i in range(0, len(g), STRING_ROWS):
            of = slice(i, i + STRING_ROWS)
            row, d, s, settled = _strings(g[of], before[of], after[of], k[of], dmin[of], dmax[of])
            row, bit = row + i, np.int64(1) << d
            told = pa.array([b"" if x else y.tobytes() for x, y in zip(settled.tolist(), s, strict=True)], pa.binary())
            yield _hits(k[row], th[row], pos[row], bit, told)
        held, names, size, opened, open_rows = [], [], 0, 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, names, size
        if held and held[0][0][0] == split_g:
            yield from give_off()
        if held:
            mask = _solve(held)
            th, pos = (np.concatenate([x[i] for x in names]) for i in range(2))
            k = np.concatenate([x[3] for x in held])
            hit = mask != 0
            if hit.any():
                yield _hits(k[hit], th[hit], pos[hit], mask[hit])
        held, names, size = [], [], 0

    for b in batches:
        if not b.num_rows:
            continue
        g, la, ra, k, th, pos, dmin, dmax, settled = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5, 6, 7, 8, 9, 10))
        if settled.any():
            yield _hits(k[settled], th[settled], pos[settled], _all_from(dmin[settled], dmax[settled]))
        live = np.flatnonzero(~settled)
        if not len(live):
            continue
        body = [np.frombuffer(b"".join(b.column(i).filter(pa.array(~settled)).to_pylist()), np.uint8).reshape(-1, width) for i in (1, 2)]
        g, la, ra, k, th, pos, dmin, dmax = (x[live] for x in (g, la, ra, k, th, pos, dmin, dmax))
        key = np.concatenate((g.view(np.uint8).reshape(-1, 8), *body, la.astype(np.uint8)[:, None], ra.astype(np.uint8)[:, None]), axis=1)
        new = np.ones(len(g), dtype=bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        if prev is not None:
            new[0] = (key[0] != prev[0]).any()
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        least = np.where(of >= 0, k[heads[np.maximum(of, 0)]] if len(heads) else 0, prev[1] if prev is not None else 0)
        copy = ~new & (k > least)
        if copy.any():
            yield _hits(k[copy], th[copy], pos[copy], _all_from(dmin[copy], dmax[copy]))
        prev = (key[-1].copy(), int(least[-1]))
        keep = np.flatnonzero(~copy)
        if not len(keep):
            continue
        # the first and the last gram and large ones by themselves, the others as runs
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(g[keep])) + 1, [len(keep)]))
        large = np.flatnonzero(np.diff(cuts) > most)
        for part in np.split(keep, np.unique(np.concatenate((cuts[[1, -2]], cuts[large], cuts[large + 1])))):
            if not len(part):
                continue
            if not held or g[part[0]] != held[-1][0][-1]:
                if size >= CHUNK_ROWS or (held and held[-1][0][-1] == split_g):
                    yield from flush()
                opened, open_rows = len(held), 0
            held.append((g[part], body[0][part], body[1][part], k[part], dmin[part], dmax[part]))
            names.append((th[part], pos[part]))
            size += len(part)
            open_rows += len(part)
            if g[part[0]] == g[part[-1]] and open_rows > most:
                own = held[opened:], names[opened:]
                held, names = held[:opened], names[:opened]
                yield from flush()
                held, names = own
                split_g = g[part[0]]
                yield from give_off()
    yield from flush()


def _hits(k: np.ndarray, th: np.ndarray, pos: np.ndarray, mask: np.ndarray, s: pa.Array | None = None) -> pa.RecordBatch:
    s = pa.nulls(len(k), pa.binary()) if s is None else s
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(th), pa.array(pos.astype(np.int32)), pa.array(mask), s], ["k", "th", "pos", "mask", "s"])


def _covered(size: int, pos: np.ndarray, mask: np.ndarray, min_len: int) -> np.ndarray:
    """Which bytes the repeated strings cover."""
    d = np.arange(int(mask.max()).bit_length()) if len(mask) else np.empty(0, np.int64)
    starts = (pos[:, None] - d)[((mask[:, None] >> d) & 1) == 1]
    mark = np.zeros(size + 1, dtype=np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + min_len, -1)
    return np.cumsum(mark)[:size] > 0


def repeated_strings(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``docs(doc_id, text)`` with ``k`` (the id, null least), ``copy`` (an earlier row has the whole text) and
    ``hits`` (repeated strings, as trigger positions with bits of distances)."""
    gram = min(GRAM, max(1, min_len // 2))
    on_workers(docs.sparkSession)
    secret = secrets.randbits(63)
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k"), F.xxhash64(F.lit(secret), text_or_empty()).alias("th"), text_or_empty().alias("text")
    )
    sizes = base.select("k", "th", F.xxhash64(F.lit(secret), F.lit("wide"), "text").alias("th2"))
    first = sizes.groupBy("th", "th2").agg(F.min("k").alias("first"))
    grams = map_arrow(base.select("th", "text"), _grams(min_len, gram, secret), "g long, th long, n int")
    of_gram = Window.partitionBy("g")
    grams = grams.select("g", "th", (F.min("th").over(of_gram) != F.max("th").over(of_gram)).alias("shared"), (F.sum("n").over(of_gram) > GROUP_ROWS).alias("heavy"))
    wanted = grams.where("shared").groupBy("th").agg(F.collect_set(F.when(~F.col("heavy"), F.col("g"))).alias("gs"), F.collect_set(F.when(F.col("heavy"), F.col("g"))).alias("many"))
    wanted = wanted.join(first.groupBy("th").agg(F.min("first").alias("k")), "th").select("k", "th", "gs", "many")
    wanted = materialize(wanted, "shared-grams")
    full = base.join(wanted, ["k", "th"]).select("k", "th", "text", "gs", "many")
    ctx = map_arrow(full, _contexts(min_len, gram, secret), _CONTEXT, CONTEXT_ROWS, CONTEXT_BYTES)
    home = F.when(F.col("settled"), F.xxhash64("k", "pos")).otherwise(F.col("g"))
    width, most = min_len - gram, GROUP_ROWS
    found = materialize(
        ctx.withColumn("home", home)
        .repartition("home")
        .sortWithinPartitions("g", "before", "after", "la", "ra", "k")
        .drop("home")
        .mapInArrow(lambda it: _repeated(it, width, most), "k long, th long, pos int, mask long, s binary"),
        "repeats",
    )
    heavy = found.where("s is not null")
    hits = found.where("s is null").drop("s")
    if heavy.limit(1).count():
        hits = hits.unionByName(heavy_hits(heavy))
    hits = hits.groupBy("k", "th").agg(F.collect_list(F.struct("pos", "mask")).alias("hits"))
    copies = sizes.join(first, ["th", "th2"]).where("k > first").select("k", "th").distinct().withColumn("copy", F.lit(True))
    told = copies.join(hits, ["k", "th"], "full")
    return base.join(told, ["k", "th"], "left").select("k", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "hits")


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``, one row for each row of ``docs``; ``kept`` has the
    remaining bytes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, spans, sha, kept = [], [], [], [], []
        for text, copy, hits in zip(b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
            raw = _raw(text)
            if copy and len(raw) >= min_len:
                out = np.ones(len(raw), dtype=bool)
            elif not hits.is_valid or copy:
                out = np.zeros(len(raw), dtype=bool)
            else:
                pos, mask = (hits.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                out = _covered(len(raw), pos.astype(np.int64), mask, min_len)
            rest = raw[~out].tobytes()
            n.append(len(raw))
            gone.append(int(out.sum()))
            spans.append(int(np.count_nonzero(np.diff(np.concatenate(([False], out)).astype(np.int8)) == 1)))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = map_arrow(repeated_strings(docs, min_len), run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.when(F.col("k") != _LEAST, F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


OP8_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) h, strlen(coalesce(text, ''))::bigint n from documents),
w as (select doc_id, p, array_slice(h, p + 1, p + 50) s from (select doc_id, h, unnest(range(0, n - 49)) p from d)),
f as (select s, min(doc_id) m from w group by s having min(doc_id) < max(doc_id)),
hit as (select w.doc_id, w.p from w join f on w.s = f.s where w.doc_id > f.m),
b as (select doc_id, p, hex(array_slice(h, p + 1, p + 1)) c from (select doc_id, h, unnest(range(0, n)) p from d)),
l as (select b.doc_id, b.p, b.c, max(hit.p) over (partition by b.doc_id order by b.p) lh
      from b left join hit on b.doc_id = hit.doc_id and b.p = hit.p),
v as (select doc_id, p, c, coalesce(p - lh < 50, false) gone from l),
g as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) head from v),
a as (select doc_id, count(*) filter (gone) n_removed, count(*) filter (head) n_spans,
             string_agg(c, '' order by p) filter (not gone) kept from g group by doc_id)
select d.doc_id, d.n n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
       sha256(unhex(coalesce(kept, ''))) kept_sha256
from d left join a using (doc_id)
"""
