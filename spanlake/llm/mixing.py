"""Mixing sources to target weights, with DataFrame functions only.

Points of the golden-ratio sequence are mapped through the cumulative target weights; each point is a slot of
one equal-token block. The slots of a source are ranked, and slot *k* takes block *k* of the source's documents
in shuffled order (wrapping round for another pass). Positions on a source's line and ranks of its slots are
two-level prefix sums (bucket totals first, then inside a bucket), so a source with a third of all rows never
meets in one task.

The slots order the mix: every prefix of it keeps the weights. ``mix_sources`` counts what the scheduled blocks take of
each document and tells its first slot; ``mixed_documents`` delivers the documents in slot order.

Defined results: a null text has size 0; a null source is a source of its own, last; sources without words get
target 0; documents of size 0 are never taken; a null doc_id is ordered as an empty one; repeated rows are separate
documents, and ties in the shuffled order go by id, text and row; a text of any length spans as many blocks as it needs;
an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 256
_PHI = 0.6180339887498949
_CHUNK = 1 << 16
_PHI_CHUNK = (_CHUNK * 11400714819323198485 % (1 << 64)) / float(1 << 64)
_BINS = 4096
_KEY = ["src", "src_null"]


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """Key, size and order of every row, and ``rid`` that tells rows apart; to be written before it is used twice."""
    return docs.select(
        (F.monotonically_increasing_id() if rid is None else rid).alias("rid"),
        "doc_id",
        "source",
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("src_null"),
        word_count().alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("ord"),
        F.xxhash64("text").alias("th"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of ``sizes(src, src_null, source_size)``, one row a source.

    A target is ``least(max_repeats * size, level * weight)`` with the one level at which all targets share the
    whole; that is where resharing the excess by weight ends. The windows run over one row a source.
    """
    by_name = Window.orderBy("src_null", "src")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w.cast("long"))
    t = t.withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("rest"))
        .withColumn("at", F.row_number().over(by_ratio))
    )
    level = F.min_by(F.when(F.col("fits"), F.col("left") / F.col("rest")), F.when(F.col("fits"), F.col("at"))).over(every)
    t = t.withColumn("level", level)
    return t.select(
        "src",
        "src_null",
        "rank",
        "weight",
        "source_size",
        "total",
        F.when(F.col("cap") <= F.col("level") * F.col("weight"), F.col("cap").cast("double"))
        .otherwise(F.col("level") * F.col("weight"))
        .alias("target"),
    )


def _line(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's place on its source's line, in the order of a hash of its id."""
    d = keyed.withColumn("bucket", F.substring("ord", 1, 3))
    sums = d.groupBy(*_KEY, "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*_KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(targets, _KEY)
    inside = Window.partitionBy(*_KEY, "bucket").orderBy("ord", "doc_id", "th", "rid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("upto", F.sum("size").over(inside))
        .join(sums, [*_KEY, "bucket"])
        .withColumn("at", F.col("base") + F.col("upto") - F.col("size"))
        .drop("base", "upto", "bucket", "th", "ord")
    )


def mix_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: ``(slot, src, src_null, source_rank, pass, block, words)``.

    ``slot`` orders the mix; ``source_rank`` is the slot's rank among its source's slots. Ranks that the golden
    points leave out at the end (a few a source) follow as the last slots; ranks beyond a target are not slots.
    """
    spark = targets.sparkSession
    t = (
        targets.where("target > 0")
        .withColumn("need", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("full", F.floor(F.col("need") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("need") - F.col("full") * F.col("source_size"))
        .withColumn("slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    )
    t = materialize(t, "mix-targets")
    n = t.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = t.withColumn("hi", F.sum("slots").over(up) / F.sum("slots").over(every))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0.0)))
    bins = share.select(
        *_KEY,
        "lo",
        "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * _BINS), F.least(F.floor(F.col("hi") * _BINS), F.lit(_BINS - 1)))).alias("bin"),
    )
    i = F.col("id")
    point = F.floor(i / _CHUNK) * F.lit(_PHI_CHUNK) + (i % _CHUNK + 1) * F.lit(_PHI)
    points = spark.range(n).select("id", (point - F.floor(point)).alias("u")).withColumn("bin", F.floor(F.col("u") * _BINS))
    dealt = points.join(bins, "bin").where("u >= lo and u < hi").select("id", *_KEY, F.floor(i / _CHUNK).alias("chunk"))
    counts = dealt.groupBy(*_KEY, "chunk").agg(F.count("*").alias("k"))
    before = Window.partitionBy(*_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    inside = Window.partitionBy(*_KEY, "chunk").orderBy("id")
    ranked = (
        dealt.withColumn("rn", F.row_number().over(inside) - 1)
        .join(bases, [*_KEY, "chunk"])
        .select("id", *_KEY, (F.col("base") + F.col("rn")).alias("source_rank"))
    )
    got = counts.groupBy(*_KEY).agg(F.sum("k").alias("got"))
    tail = (
        t.join(got, _KEY, "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < slots")
        .select(F.lit(None).cast("long").alias("id"), *_KEY, F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("source_rank"))
    )
    s = ranked.unionByName(tail).join(t.drop("rank", "weight", "total", "target"), _KEY).where("source_rank < slots")
    s = s.withColumn("pass", F.floor(F.col("source_rank") / F.col("blocks")).cast("long"))
    s = s.withColumn("block", F.col("source_rank") - F.col("pass") * F.col("blocks"))
    end = F.when(F.col("pass") < F.col("full"), F.col("source_size")).otherwise(F.col("rest"))
    return s.select(
        F.coalesce("id", F.lit(n) + F.col("source_rank")).alias("slot"),
        *_KEY,
        "source_rank",
        "pass",
        "block",
        F.least(F.lit(block_words), end - F.col("block") * block_words).cast("long").alias("words"),
    )


def mix_copies(keyed: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(rid, pass, slot, words)``: every pass of the mix through a row of ``keyed``, with the slot of the first block
    that takes words of it and how many are taken in the pass."""
    line = _line(keyed, targets.select(*_KEY, "source_size", "target"))
    b = F.lit(block_words)
    parts = line.where("size > 0").select(
        "rid", *_KEY, "at", "size", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block")
    )
    lo = F.greatest(F.col("at") - F.col("block") * b, F.lit(0))
    hi = F.least(F.col("at") + F.col("size") - F.col("block") * b, F.col("words"))
    slots = mix_schedule(targets, block_words).select("slot", *_KEY, "pass", "block", "words")
    some = parts.join(slots, [*_KEY, "block"]).withColumn("got", hi - lo).where("got > 0")
    return some.groupBy("rid", "pass").agg(F.min("slot").alias("slot"), F.sum("got").cast("long").alias("words"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, first_slot)``, one row for each row of
    ``docs(doc_id, text, source)``.

    ``taken`` counts the document's words in all scheduled blocks, repeats included, and ``first_slot`` is the first
    slot of the mix that has some (-1: none). The taken words of a source add up to its target, rounded to a word; a
    document is taken 3 times at most.
    """
    keyed = materialize(_keyed(docs), "mix-docs")
    targets = _targets(keyed)
    taken = mix_copies(keyed, targets, block_words).groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = keyed.join(targets.select(*_KEY, "source_size", "target"), _KEY).join(taken, "rid", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))


def _targets(keyed: DataFrame) -> DataFrame:
    return materialize(source_targets(keyed.groupBy(*_KEY).agg(F.sum("size").alias("source_size"))), "mix-sources")


def _first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, with its own white space."""
    words, between = F.regexp_extract_all(text, F.lit(f"({WORD})")), F.split(text, WORD, -1)
    return F.array_join(F.zip_with(F.slice(between, F.lit(1), n), F.slice(words, F.lit(1), n), lambda s, w: F.concat(s, w)), "")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, with the columns of ``docs``, in the order of its slots: by partition and row, and so by file and row
    once it is written (``tokens.write_tokens`` follows that order with ``file_order``).

    Each pass through a document is a row, at the slot of its first block; a pass that the target cuts short (at most
    one a source) has the first words of the text, its white space as it was. ``n_chars``, where there is one, follows
    the text. Documents of size 0 are not in the mix; repeated rows are mixed one by one; an empty table gives an empty
    mix; columns of any name come through as they are.
    """
    rid, slot, words, size = free_names(docs, "rid", "slot", "words", "size")
    numbered = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-texts")
    keyed = materialize(_keyed(numbered, F.col(rid)), "mix-docs")
    copies = mix_copies(keyed, _targets(keyed), block_words).join(keyed.select("rid", "size"), "rid")
    copies = copies.select(F.col("rid").alias(rid), F.col("slot").alias(slot), F.col("words").cast("int").alias(words), F.col("size").alias(size))
    j = numbered.join(copies, rid)
    cut = F.col(words) < F.col(size)
    out = j.withColumn("text", F.when(cut, _first_words(F.col("text"), F.col(words))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.repartitionByRange(F.col(slot)).sortWithinPartitions(slot, rid).select(*docs.columns)


OP3_SQL = rf"""
with d as (select doc_id, coalesce(source, '') src, source is null src_null,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
                  md5(cast(doc_id as varchar)) ord from documents),
s as (select src, src_null, sum(size)::bigint source_size from d group by all),
r as (select *, row_number() over (order by src_null, src) - 1 as rnk from s),
w as (select *, case rnk % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from r),
c as (select *, sum(source_size) over () - coalesce(sum(cap) over o, 0) as lft,
             sum(weight) over () - coalesce(sum(weight) over o, 0) as rest
      from w window o as (order by cap / weight, rnk rows between unbounded preceding and 1 preceding)),
l as (select min_by(lft::double / rest::double, cap / weight) as lvl from c where lft * weight <= cap * rest),
t as (select src, src_null, rnk, source_size, case when cap <= lvl * weight then cap::double else lvl * weight end as target from w, l),
n as (select *, cast(floor(target + 0.5) as bigint) as need, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} as blocks from t),
k as (select *, case when source_size > 0 then need // source_size else 0 end as n_full from n),
q as (select *, need - n_full * source_size as rest, n_full * blocks + (need - n_full * source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} as slots from k),
h as (select *, (sum(slots) over (order by rnk))::double / (sum(slots) over ())::double as hi from q where target > 0),
v as (select *, coalesce(lag(hi) over (order by rnk), 0.0::double) as lo, (sum(slots) over ())::bigint as total from h),
p as (select i, x - floor(x) as u from (
        select i, (i // {_CHUNK})::double * {_PHI_CHUNK!r}::double + (i % {_CHUNK} + 1)::double * {_PHI!r}::double as x
        from (select unnest(range(0, (select max(total) from v))) as i))),
dealt as (select i as slot, src, src_null, row_number() over (partition by src, src_null order by i) - 1 as source_rank from p join v on u >= lo and u < hi),
got as (select src, src_null, count(*) as g from dealt group by all),
tail as (select total + unnest(range(coalesce(g, 0), slots)) as slot, src, src_null, unnest(range(coalesce(g, 0), slots)) as source_rank
         from v left join got using (src, src_null)),
sl as (select a.slot, a.src, a.src_null, a.source_rank // blocks as pass, a.source_rank % blocks as block, source_size, n_full, rest
       from (from dealt union all from tail) a join v using (src, src_null) where a.source_rank < slots),
sw as (select *, least({BLOCK_WORDS}, case when pass < n_full then source_size else rest end - block * {BLOCK_WORDS}) as words from sl),
line as (select d.*, coalesce(sum(size) over (partition by src, src_null order by ord, doc_id rows between unbounded preceding and 1 preceding), 0) as pos from d),
part as (select doc_id, src, src_null, pos, size, unnest(range((pos // {BLOCK_WORDS})::bigint, ((pos + size - 1) // {BLOCK_WORDS})::bigint + 1)) as block from line where size > 0),
took as (select doc_id, slot, least(pos + size - block * {BLOCK_WORDS}, words) - greatest(pos - block * {BLOCK_WORDS}, 0) as got
         from part join sw using (src, src_null, block)),
f as (select doc_id, sum(got)::bigint as taken, min(slot)::bigint as first_slot from took where got > 0 group by doc_id)
select doc_id, nullif(src, case when src_null then '' end) as source, size, source_size, target,
       coalesce(taken, 0)::bigint as taken, coalesce(first_slot, -1)::bigint as first_slot
from d join t using (src, src_null) left join f using (doc_id)
"""
