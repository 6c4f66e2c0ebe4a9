"""Canonical exact digests, with DataFrame functions only.

The canonical text is NFKC, case-folded, NFKC again (by the Unicode library that Spark ships, through the SQL
function ``reflect``; pure ASCII only needs lower case), with each run of white space made one space and none at
the ends. The digest is two 64-bit xxhash values with different seeds. Texts of equal digest form a bucket; the
least and the greatest canonical text of a bucket are compared byte by byte (an aggregate that Spark combines
before its shuffle, so a bucket of a third of all rows costs a row a task), and a bucket that holds two different
texts has its digests extended by SHA-256 of the text.

Defined results: a null text is empty; a null doc_id stands before all others; where a doc_id comes on several
rows, the next document of a row is the least text of the next doc_id; repeated rows are told each; an only document is
its own next; a text of any length is read whole; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .ranges import with_next

_NORMALIZER = "com.ibm.icu.text.Normalizer"
_CHARACTERS = "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.reflect(F.lit(_NORMALIZER), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.reflect(F.lit(_CHARACTERS), F.lit("foldCase"), nfkc(text), F.lit(True)))
    # a text of as many bytes as characters is ASCII
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(plain, r"[\s\x{85}\x{A0}\x{2028}\x{2029}\p{Zs}]+", " "))


def _hashes(canon: Column) -> list[Column]:
    return [F.xxhash64(canon).alias("h1"), F.xxhash64(F.lit("wide"), canon).alias("h2")]


def _digest(h1: str, h2: str) -> Column:
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def _rows(docs: DataFrame) -> DataFrame:
    """``k1, k2`` (the id, null first), text and digest halves of every row."""
    kind = docs.schema["doc_id"].dataType
    d = docs.select(
        F.col("doc_id").isNotNull().alias("k1"), F.coalesce(F.col("doc_id"), F.lit(0).cast(kind)).alias("k2"), text_or_empty().alias("text")
    )
    return d.withColumn("canon", canonical(F.col("text"))).select("k1", "k2", "text", *_hashes(F.col("canon")))


def _collisions(rows: DataFrame, multi: DataFrame) -> DataFrame:
    """Digests ``(h1, h2)`` under which different canonical texts meet; ``multi`` has the ids in buckets of 2 or more."""
    members = rows.join(multi, ["k1", "k2"], "left_semi").withColumn("canon", canonical(F.col("text")))
    ends = members.groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    return ends.where("lo <> hi").select("h1", "h2")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, fingerprint, copies)``: the digest of every row of ``docs`` and the size of its bucket."""
    rows = _rows(docs)
    small = materialize(rows.select("k1", "k2", F.char_length("text").alias("n"), "h1", "h2"), "digests")
    sizes = small.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    multi = small.join(sizes.where("copies > 1"), ["h1", "h2"], "left_semi").select("k1", "k2").distinct()
    bad = materialize(_collisions(rows, multi), "collisions")
    told = rows.join(bad.withColumn("bad", F.lit(True)), ["h1", "h2"], "left").join(sizes, ["h1", "h2"])
    fp = _digest("h1", "h2")
    return told.withColumn("canon", F.when(F.col("bad"), canonical(F.col("text")))).select(
        F.when(F.col("k1"), F.col("k2")).alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.when(F.col("bad"), F.concat(fp, F.sha2("canon", 256))).otherwise(fp).alias("fingerprint"),
        "copies",
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Digests of every text, of its edited text, and their likeness (1 if canonically equal, else 0).

    The edited text has its last quarter (rounded down to characters) replaced by as many first characters of the
    next document. Documents are shuffled once by id; the next document's share of text goes to the id before it.
    """
    rows = _rows(docs)
    small = materialize(rows.select("k1", "k2", F.char_length("text").alias("n"), "h1", "h2"), "digests")
    nxt = with_next(small, ["k1", "k2"], wrap=True)
    heads = small.groupBy("k1", "k2").agg(F.floor(F.max("n") / 4).cast("int").alias("quarter"), F.min("h1").alias("own1"))
    want = nxt.join(heads, ["k1", "k2"]).select(
        F.col("k1").alias("to1"), F.col("k2").alias("to2"), "quarter", "own1", F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2")
    )
    same = F.col("own1") == F.col("h1")  # only then can the texts be equal, and the whole next text goes along
    heads_of = rows.join(want, ["k1", "k2"]).select(
        F.col("to1").alias("k1"),
        F.col("to2").alias("k2"),
        F.struct(
            F.expr("substring(text, 1, quarter)").alias("head"), F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.when(same, F.col("text")).alias("whole")
        ).alias("nx"),
    )
    heads_of = heads_of.groupBy("k1", "k2").agg(F.min("nx").alias("nx"))
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    e = rows.join(heads_of, ["k1", "k2"]).select(
        "*", n.alias("n"), F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.substring(F.col("nx.head"), F.lit(1), q)).alias("edited")
    )
    e = e.withColumn("ecanon", canonical(F.col("edited")))
    e = e.select("*", *[c.alias(a) for c, a in zip(_hashes(F.col("ecanon")), ("e1", "e2"), strict=True)])
    e_same = (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2"))
    n_same = (F.col("nx.n1") == F.col("h1")) & (F.col("nx.n2") == F.col("h2")) & F.col("nx.whole").isNotNull()
    # equal digests are believed only if the bytes agree; canonical texts are made again only for those rows
    need = e_same | n_same
    e = e.withColumn("canon", F.when(need, canonical(F.col("text")))).withColumn("ncanon", F.when(n_same, canonical(F.col("nx.whole"))))
    sizes = small.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    multi = small.join(sizes.where("copies > 1"), ["h1", "h2"], "left_semi").select("k1", "k2").distinct()
    bad = _collisions(rows, multi).withColumn("bad", F.lit(True))
    e = e.select(
        F.when(F.col("k1"), F.col("k2")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "h1",
        "h2",
        F.when(e_same & (F.col("canon") != F.col("ecanon")), F.concat(_digest("e1", "e2"), F.sha2("ecanon", 256))).otherwise(_digest("e1", "e2")).alias("edited_fingerprint"),
        F.when(e_same & (F.col("canon") == F.col("ecanon")), 1.0).otherwise(0.0).alias("near_edited"),
        F.when(n_same & (F.col("canon") == F.col("ncanon")), 1.0).otherwise(0.0).alias("near_next"),
        F.sha2(F.coalesce("canon", F.lit("")), 256).alias("sha"),
    )
    fp = _digest("h1", "h2")
    return e.join(bad, ["h1", "h2"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.when(F.col("bad"), F.concat(fp, F.col("sha"))).otherwise(fp).alias("fingerprint"),
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
