"""External string dictionaries: building, resolving and decoding hashed tokens ``@@16HEX@@``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import on_workers
from ..operators.numbering import numbered

TOKEN = "@@([0-9A-F]{16})@@"
# fixed values: offset basis and prime of FNV-1a, 64 and 32 bits
FNV = {64: (14695981039346656037, 1099511628211), 32: (2166136261, 16777619)}


def fnv1a(texts: list[str] | pa.Array, bits: int = 64, salt: int = 0) -> np.ndarray:
    """FNV-1a of many strings at once, byte position by byte position from the longest string on; the salt is mixed into
    the basis. Memory is that of the texts, whatever their lengths. A null is hashed as the empty string."""
    basis, prime = FNV[bits]
    kind = np.uint64 if bits == 64 else np.uint32
    raw = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    flat = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    n = np.diff(ends)
    if raw.null_count:
        n = np.where(raw.is_null().to_numpy(zero_copy_only=False), 0, n)
    longest = np.argsort(-n, kind="stable")
    starts, sizes = ends[:-1][longest], n[longest]
    h = np.full(len(raw), (basis + salt) % (1 << bits), dtype=kind)
    live = len(raw)
    for k in range(int(n.max(initial=0))):
        while sizes[live - 1] <= k:
            live -= 1
        h[:live] = (h[:live] ^ flat[starts[:live] + k].astype(kind)) * kind(prime)
    out = np.empty_like(h)
    out[longest] = h
    return out


def _fnv(df: DataFrame, column: str, bits: int, salt: int):
    """FNV-1a of a text column as the bits of a long."""
    on_workers(df.sparkSession)

    @F.arrow_udf("long")
    def run(s: pa.Array) -> pa.Array:
        h = fnv1a(s, bits, salt)
        return pa.array(h.view(np.int64) if bits == 64 else h.astype(np.int64), mask=s.is_null().to_numpy(zero_copy_only=False))

    return run(F.col(column))


def _hex(h: str):
    return F.lpad(F.hex(h), 16, "0")


def hash_column(df: DataFrame, column: str, bits: int = 64, salt: int = 0):
    """FNV-1a of a text column as upper-case hex of 16 digits."""
    return _hex(_fnv(df, column, bits, salt))


def _hashed(df: DataFrame, column: str, bits: int, salt: int) -> DataFrame:
    d = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return d.withColumn("h", _fnv(d, "value", bits, salt))


def build_dictionary(df: DataFrame, column: str, bits: int = 64, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(hash, value)`` of the distinct strings, and ``(hash, values)`` of hashes that several strings share."""
    d = _hashed(df, column, bits, salt)
    shared = d.groupBy("h").agg(F.collect_list("value").alias("values")).where(F.size("values") > 1)
    return d.select(_hex("h").alias("hash"), "value"), shared.select(_hex("h").alias("hash"), "values")


def count_collisions(df: DataFrame, column: str, bits: int = 64, salt: int = 0) -> DataFrame:
    """``(hash, n)`` of hashes that ``n`` strings share, more than one; the strings of no hash are gathered."""
    n = _hashed(df, column, bits, salt).groupBy("h").agg(F.count("*").cast("int").alias("n"))
    return n.where("n > 1").select(_hex("h").alias("hash"), "n")


def read_dictionary(spark: SparkSession, path: str, salt: int = 0) -> DataFrame:
    """``(hash, value)`` of lines ``@@16HEX@@text``: digits of either case, the first line of a hash wins (files in the
    order of their names). The empty string is known under its 64- and 32-bit hashes with the salt."""
    line = F.regexp_extract("value", "^@@([0-9A-Fa-f]{16})@@", 1)
    t = spark.read.text(path).select(
        F.upper(line).alias("hash"), F.expr("substring(value, 21)").alias("value"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"),
    )
    t = t.where("hash <> ''").groupBy("hash").agg(F.min_by("value", "at").alias("value"))
    known = [f"{(basis + salt) % (1 << bits):016X}" for bits, (basis, _) in FNV.items()]
    empty = spark.createDataFrame([(h, "") for h in known], "hash string, value string")
    return t.join(empty.select("hash"), "hash", "left_anti").unionByName(empty)


def resolve_strings(df: DataFrame, dictionary: DataFrame, column: str = "hash") -> DataFrame:
    """``df`` with ``text``; an unknown hash stays ``@@HASH@@`` and a null one is null. Digits of either case are alike."""
    d = dictionary.select(F.upper("hash").alias("_h"), F.col("value").alias("_v"))
    j = df.join(d, F.upper(F.col(column)) == F.col("_h"), "left")
    return j.withColumn("text", F.coalesce("_v", F.concat(F.lit("@@"), F.col(column), F.lit("@@")))).drop("_v", "_h")


def decode_text(df: DataFrame, column: str, dictionary: DataFrame, key: str) -> DataFrame:
    """``(key, decoded)``: every token of a text replaced by its string, unknown tokens by the bare hex; null stays null.

    ``key`` is unique. Texts are cut at their tokens, the tokens are joined to the dictionary and put back in order.
    """
    rests, tokens = F.split(F.col(column), TOKEN, -1), F.regexp_extract_all(F.col(column), F.lit(TOKEN), F.lit(1))
    cut = F.arrays_zip(rests.alias("rest"), F.concat(F.array(F.lit(None).cast("string")), tokens).alias("hash"))
    parts = df.select(key, F.posexplode_outer(cut).alias("at", "p")).select(key, "at", "p.rest", "p.hash")
    got = parts.join(dictionary.select("hash", F.col("value").alias("_v")), "hash", "left").withColumn("_t", F.concat(F.coalesce("_v", "hash", F.lit("")), F.col("rest")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_t"))), lambda x: x["_t"]), "")
    return got.groupBy(key).agg(F.when(F.count("rest") > 0, whole).alias("decoded"))


def first_seen_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """``(value, id)``: ids by first appearance of the distinct values."""
    first = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_at"))
    return numbered(first, ["_at", "value"], "id").select("value", "id")
