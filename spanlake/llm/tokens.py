"""Token ids in a static range-ANS file format, written and read block by block.

A file set is a folder of three Parquet tables: ``table`` (the one shared frequency table), ``blocks`` (a row a
block: the coded bytes and the directory of the whole documents in it) and ``manifest`` (ids before each shard).
A block is coded by itself: its ids are dealt to interleaved lanes, every lane a 64-bit rANS state that gives off
32-bit words; checkpoints hold all lane states every ``CHECKPOINT`` steps, so that a reader can begin inside a
block, and checksums guard the words and the decoded ids. Parquet supplies commit, retry and any file system.

Defined results: a null text is empty (only the end id); a null doc_id sorts first; rows with the same doc_id follow
by a hash of their ids, then by the ids, and repeated rows are written each; a text of any length is encoded whole and
stands in one block; an empty table gives empty files and an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, hold, map_arrow, materialize, new_path, release_memory, text_or_empty
from .wordbpe import WordEncoder, id_type, vocabulary

END_ID = 1
LANES = 1024
BLOCK_IDS = 1 << 18
CHECKPOINT = 128
LOW = 1 << 31
ENCODE_ROWS, ENCODE_BYTES = 2000, 3 << 20
_HEAD = struct.Struct("<4sIIIQQIII")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- coder


def shared_frequencies(counts: np.ndarray, bits: int = 16) -> tuple[np.ndarray, int]:
    """Counts scaled to sum to ``2**bits``, at least 1 where the count is not 0; more bits for larger alphabets."""
    present = np.flatnonzero(counts)
    bits = max(bits, int(len(present)).bit_length() + 2)
    total = 1 << bits
    freq = np.zeros(len(counts), dtype=np.int64)
    if not len(present):
        return freq, bits
    c = counts[present].astype(np.float64)
    f = np.maximum(1, np.floor(c * (total / c.sum()))).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    short = total - int(f.sum())
    if short > 0:
        f[order[0]] += short
    k = 0
    while short < 0:
        i = order[k % len(order)]
        cut = min(-short, max(0, int(f[i]) // 16), int(f[i]) - 1) or (1 if f[i] > 1 else 0)
        f[i] -= cut
        short += cut
        k += 1
    freq[present] = f
    return freq, bits


class Coder:
    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
        n = len(ids)
        while lanes > 1 and lanes * 16 > n:
            lanes //= 2
        if n and int(self.freq[ids].min()) == 0:
            raise ValueError("an id has no place in the shared frequency table")
        x = np.full(lanes, LOW, dtype=np.uint64)
        steps = -(-n // lanes)
        words, marks, emitted = [], [], 0
        shift, top = np.uint64(self.bits), np.uint64(63 - self.bits)
        w32, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            f = self.freq[s]
            xs = x[: len(s)]
            full = xs >= (f << top)
            if full.any():
                out = (xs[full] & low32).astype("<u4")
                words.append(out)
                emitted += len(out)
                xs = np.where(full, xs >> w32, xs)
            q = xs // f
            x[: len(s)] = (q << shift) + (xs - q * f) + self.cum[s]
            if t and t % every == 0:
                marks.append((t, emitted, x.copy()))
        body = b"".join(w.tobytes() for w in reversed(words))
        side = x.astype("<u8").tobytes() + b"".join(
            struct.pack("<IQ", t, emitted - e) + s.astype("<u8").tobytes() for t, e, s in reversed(marks)
        )
        head = _HEAD.pack(
            b"RNS1", lanes, self.bits, every, n, emitted, len(marks), zlib.crc32(side + body), zlib.crc32(ids.astype("<u4").tobytes())
        )
        return head + side + body

    def decode(self, block: bytes, part: int | None = None) -> np.ndarray:
        """All ids of a block, or those from its checkpoint ``part`` (0 is the start) to the next one."""
        magic, lanes, bits, every, n, n_words, n_marks, crc, ids_crc = _HEAD.unpack_from(block)
        if magic != b"RNS1" or bits != self.bits:
            raise ValueError("not a block of this file set")
        if zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
            raise ValueError("a block's checksum differs")
        at = _HEAD.size
        x = np.frombuffer(block, "<u8", lanes, at).astype(np.uint64)
        at += 8 * lanes
        step = 12 + 8 * lanes
        words = np.frombuffer(block, "<u4", n_words, at + n_marks * step)
        steps, first, pos = -(-n // lanes), 0, 0
        if part is not None:
            if part:
                first, pos = struct.unpack_from("<IQ", block, at + (part - 1) * step)
                x = np.frombuffer(block, "<u8", lanes, at + (part - 1) * step + 12).astype(np.uint64)
            steps = min(steps, struct.unpack_from("<I", block, at + part * step)[0] if part < n_marks else steps)
        out = np.empty(max(0, min(n, steps * lanes) - first * lanes), dtype=np.uint32)
        shift, mask, w32 = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.uint64(32)
        for t in range(first, steps):
            m = min(lanes, n - t * lanes)
            xs = x[:m]
            slot = xs & mask
            s = self.symbol[slot]
            out[(t - first) * lanes : (t - first) * lanes + m] = s
            xs = self.freq[s] * (xs >> shift) + slot - self.cum[s]
            need = xs < LOW
            k = int(np.count_nonzero(need))
            if k:
                xs[need] = (xs[need] << w32) | words[pos : pos + k]
                pos += k
            x[:m] = xs
        if part is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("the checksum of decoded ids differs")
        return out


def n_parts(block: bytes) -> int:
    """Entry points of a block: its start and its checkpoints."""
    return _HEAD.unpack_from(block)[6] + 1


# ---------------------------------------------------------------- tables


def _in_files(docs: DataFrame) -> bool:
    """Whether Spark can tell where the rows of ``docs`` stand in files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, file_order: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of every whole text; ids are little-endian, 16 bits where the vocabulary allows.

    With ``file_order`` also ``part`` and ``row``, where a row stands in the files from which ``docs`` are read.
    """
    at = [F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("row")] if file_order else []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = WordEncoder.of(tokenizer).encode(b.column(1), end_id)
        return pa.RecordBatch.from_arrays([b.column(0), ids, *b.columns[2:]], ["doc_id", "ids", *["part", "row"][: b.num_columns - 2]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", part long, row long" if file_order else ""
    return map_arrow(docs.select("doc_id", text_or_empty().alias("text"), *at), run, f"doc_id {kind}, ids binary{more}", ENCODE_ROWS, ENCODE_BYTES)


def _token_counts(coded: DataFrame, dtype: str, vocab: int) -> np.ndarray:
    """Counts of all ids, summed by Spark; at most one row for each id of the vocabulary comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token-counts", lambda: None)  # the texts are encoded: this worker's words and encoder may go
        release_memory()
        c = np.zeros(vocab, dtype=np.int64)
        for b in batches:
            x = b.column(0)
            if len(x):
                offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
                c += np.bincount(np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(dtype), minlength=vocab)
        i = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(c[i])], ["id", "n"])

    sums = coded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocab, dtype=np.int64)
    out[sums["id"].to_numpy()] = sums["n"].to_numpy()
    return out


def _blocks(it: Iterator[pa.RecordBatch], coder: Coder, dtype: str, block_ids: int) -> Iterator[pa.RecordBatch]:
    shard, start = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def row() -> pa.RecordBatch:
        nonlocal start, size, held
        ids = np.frombuffer(b"".join(x for _, x in held), dtype).astype(np.int64)
        n = [len(x) // np.dtype(dtype).itemsize for _, x in held]
        cols = [
            pa.array([shard], pa.int32()),
            pa.array([start], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.array([[d for d, _ in held]], pa.list_(kind)),
            pa.array([n], pa.list_(pa.int32())),
            pa.array([coder.encode(ids)], pa.binary()),
        ]
        start, size, held = start + len(ids), 0, []
        return pa.RecordBatch.from_arrays(cols, ["shard", "start", "n_ids", "doc_ids", "lengths", "block"])

    kind = pa.int64()
    for b in it:
        kind = b.schema.field(0).type
        for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.append((d, x))
            size += len(x) // np.dtype(dtype).itemsize
            if size >= block_ids:
                yield row()
    if held:
        yield row()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, block_ids: int = BLOCK_IDS, file_order: bool = False) -> None:
    """Encode all texts of ``docs(doc_id, text)`` and write the file set to ``path``, in ascending doc_id order.

    With ``file_order`` texts come in the order in which the files of ``docs`` hold them, so that a mix stays mixed; ``docs``
    are then one table as Spark wrote it, which numbers its files. Where they are in no files they are written first, in the
    order of their partitions and rows.
    """
    spark = docs.sparkSession
    if file_order and not _in_files(docs):
        docs = materialize(docs.select("doc_id", "text"), "token-texts")
    vocab = vocabulary(tokenizer)
    dtype = id_type(vocab).str
    with arrow_rows(spark, ENCODE_ROWS):
        coded = materialize(encode_texts(docs, tokenizer, end_id, file_order), "token-ids")
    order = ["part", "row"] if file_order else ["doc_id", "h", "ids"]
    counts = _token_counts(coded, dtype, vocab)
    freq, bits = shared_frequencies(counts)
    used = np.flatnonzero(freq)
    rows = pa.table({"id": pa.array(used.astype(np.int32)), "freq": pa.array(freq[used]), "n": pa.array(counts[used])})
    spark.createDataFrame(rows, "id int, freq long, n long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((freq, bits))  # one entry for each id of the vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = (
        coded.withColumn("h", F.xxhash64("ids"))
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .select("doc_id", "ids")
        .mapInArrow(
            lambda it: _blocks(it, Coder(*shared.value), dtype, block_ids),
            f"shard int, start long, n_ids long, doc_ids array<{kind}>, lengths array<int>, block binary",
        )
    )
    with arrow_rows(spark, ENCODE_ROWS):
        blocks.write.parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def read_coder(spark: SparkSession, path: str) -> Coder:
    """The coder of a file set, from its frequency table (one row for each id of the vocabulary at most)."""
    t = spark.read.parquet(f"{path}/table").toPandas()
    freq = np.zeros(int(t["id"].max()) + 1 if len(t) else 1, dtype=np.int64)
    freq[t["id"].to_numpy()] = t["freq"].to_numpy()
    return Coder(freq, max(0, int(freq.sum()).bit_length() - 1))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document of a file set, decoded from its blocks."""
    coder = spark.sparkContext.broadcast(read_coder(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/manifest").select("shard", "base"), "shard")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        doc, start, n, crc, raw = [], [], [], [], []
        for base, at, ids, lens, block in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            out = coder.value.decode(block)
            ends = np.cumsum(lens)
            for d, e, k in zip(ids, ends.tolist(), lens, strict=True):
                x = out[e - k : e].astype("<u4").tobytes()
                doc.append(d)
                start.append(base + at + e - k)
                n.append(k)
                crc.append(zlib.crc32(x))
                if with_ids:
                    raw.append(np.frombuffer(x, "<u4").astype(np.int32))
        cols = [pa.array(doc, b.schema.field(2).type.value_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            cols.append(pa.array(raw, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    out = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(blocks.select("base", "start", "doc_ids", "lengths", "block"), run, out)


def token_file(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, file_order: bool = False) -> DataFrame:
    """Write the file set of ``docs`` (to the shared folder if no path is given) and return what a reader finds in it."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or word_bpe_path(), file_order=file_order)
    return read_tokens(spark, path)
