"""Named queries over live traces: the given tables arrive as files, a stream runs to their end, and its output is read.

Each has the SQL of the batch operator that it must equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import select
from ..streaming import live
from ..tables import new_path
from . import fixtures as fx

PARTS = 4
BINS = 1000
FILE_ROWS = 1 << 18
STATE_PARTITIONS = 4  # at least; a state store is opened for each, and a core for each pays


@contextmanager
def _few_stores(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def arrive(df: DataFrame, label: str, part: str = "seq", parts: int = PARTS) -> tuple[str, DataFrame]:
    """``df`` written part by part in the order of ``part``, a file for each ``FILE_ROWS`` rows, and the stream that reads as many
    files at a time as a part has."""
    spark = df.sparkSession
    path, cut = new_path(spark, label), new_path(spark, f"{label}-cut")
    lo, hi, n = df.agg(F.min(part), F.max(part), F.count("*")).first()
    df.withColumn("_at", F.floor((F.col(part) - lo) * parts / (hi - lo + 1)).cast("int")).write.partitionBy("_at").parquet(cut)
    files = -(-n // (parts * FILE_ROWS))
    schema = df.drop("_part").schema
    for i in range(parts):
        rows = spark.read.schema(StructType([*df.schema.fields, StructField("_at", IntegerType())])).parquet(cut).where(F.col("_at") == i).select(*schema.names)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    return path, live.read_live(spark, path, schema, files)


def finished(sdf: DataFrame, label: str) -> DataFrame:
    """The output of a stream that has read all there is."""
    path = new_path(sdf.sparkSession, label)
    with _few_stores(sdf.sparkSession):
        q = sdf.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(f"{path}/out")


def disordered(df: DataFrame, parts: int = 6, span: int = 400) -> tuple[DataFrame, str]:
    """``df`` out of order: rows come up to ``span`` rows late, some twice, the second time a file later; with the delay of a
    watermark that covers it, also where dates go back along ``seq``. A row of no thread follows far in the future, so that the watermark passes all others."""
    d = df.withColumn("ts", F.timestamp_micros(F.expr("date_ns div 1000"))).withColumn("_part", F.col("seq") + F.pmod(F.col("seq") * 7919, F.lit(span)))
    lo, hi, t0, t1 = d.agg(F.min("_part"), F.max("_part"), F.min("date_ns"), F.max("date_ns")).first()
    step = (hi - lo) // parts + 1
    again = d.where("seq % 17 = 0").withColumn("_part", F.col("_part") + step)
    last = d.orderBy(F.desc("seq")).limit(1)
    far = {"stream_id": F.lit(-1).cast("long"), "thread_id": F.lit(-1).cast("long"), "ts": F.timestamp_seconds(F.lit((t1 - t0) * 10 // 10**9 + 10**6)), "_part": F.lit(hi + 2 * step)}
    # what a row, or one of a lower seq that comes after it, is behind the latest one before it, bounded by bins, wherever files are cut
    bins = d.groupBy(F.expr(f"(_part - {lo}) div {(hi - lo) // BINS + 1}").alias("b")).agg(F.min("date_ns").alias("first"), F.max("date_ns").alias("last"))
    again_at = bins.select((F.col("b") + max(step, span) // ((hi - lo) // BINS + 1) + 1).alias("b"), "first", F.lit(t0).alias("last"))
    late, top = 0, t0
    for b in bins.unionByName(again_at).orderBy("b", F.desc("last")).collect():  # two rows a bin
        top = max(top, b["last"])
        late = max(late, top - b["first"])
    delay = max(3 * (t1 - t0) // parts, late) // 10**9 + 60
    return d.unionByName(again).unionByName(last.withColumns(far)), f"{delay} seconds"


_CLOSED = "stream_id, thread_id, scope_id, level::int as level, name, start_ns, end_ns, duration_ns, is_open from sc where not is_open"
_SPECS = [select.EventSpec(("op0/op1",)), select.EventSpec((".op2",)), select.EventSpec(("m0", "m1"), parent="op1")]


def _r1(s: SparkSession, d: str) -> DataFrame:
    return finished(arrive(fx.trace(s, d), "live")[1], "ingested").groupBy("stream_id", "kind").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def _r2(s: SparkSession, d: str) -> DataFrame:
    return finished(live.pair_scopes_stream(arrive(fx.trace(s, d), "live")[1], forward=False), "pairs")


def _r3_uses(s: SparkSession, d: str) -> DataFrame:
    return finished(live.lock_uses_stream(arrive(fx.locks(s, d), "live")[1]), "uses")


def _r3_allocations(s: SparkSession, d: str) -> DataFrame:
    return finished(live.allocations_stream(arrive(fx.memory(s, d), "live")[1]), "allocations")


def _r4(s: SparkSession, d: str) -> DataFrame:
    out = finished(live.select_events_stream(arrive(fx.trace(s, d), "live")[1], _SPECS), "selected")
    return out.select("spec_id", "stream_id", "thread_id", "seq", F.array_join("path", "/").alias("path"), "parent_match")


def _r5(s: SparkSession, d: str) -> DataFrame:
    rows, delay = disordered(fx.trace(s, d))
    return finished(live.pair_scopes_stream(arrive(rows, "late", "_part", 8)[1], watermark=("ts", delay)), "pairs")


def _r6(s: SparkSession, d: str) -> DataFrame:
    return live.follow(finished(arrive(fx.trace(s, d), "live")[1], "ingested"), 10**15).select("stream_id", "thread_id", "seq", "date_ns", "kind", "name")


def _e7(s: SparkSession, d: str) -> DataFrame:
    with _few_stores(s):
        events = live.select_events_stream(arrive(fx.trace(s, d), "live", parts=8)[1], _SPECS[:2])
        got, _ = live.collect_stream(events, new_path(s, "collected"), wanted=[0, 1], timeout_s=600)
    return got.select("spec_id", "stream_id", "thread_id", "seq")


_HIT = """hit as (select 0 as spec_id, stream_id, thread_id, scope_id as seq, path, null::bigint as parent_match from paths where regexp_matches(path, '(^|/)op0/op1$')
union all select 1, stream_id, thread_id, scope_id, path, null from paths where path = 'op2')"""
_UNDER = """anc as (with recursive r as (select a.stream_id, a.thread_id, a.seq, a.name, a.parent_id as up, a.parent_id as anc_id from att a where parent_id is not null
union all select r.stream_id, r.thread_id, r.seq, r.name, r.up, p.parent_id from r join par p on p.stream_id = r.stream_id and p.thread_id = r.thread_id and p.scope_id = r.anc_id where p.parent_id is not null) select * from r),
und as (select 2 as spec_id, anc.stream_id, anc.thread_id, anc.seq, any_value(p.path) || '/' || any_value(anc.name) as path, min(anc_id) as parent_match from anc join sc on sc.stream_id = anc.stream_id and sc.thread_id = anc.thread_id and sc.scope_id = anc_id
join paths p on p.stream_id = anc.stream_id and p.thread_id = anc.thread_id and p.scope_id = anc.up where sc.name = 'op1' group by anc.stream_id, anc.thread_id, anc.seq)"""

LIVE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "r1_live_ingestion": (_r1, fx.sql("trace", " select stream_id, kind, count(*) n, max(seq) as last from trace group by all")),
    "r2_pair_stream": (_r2, fx.sql("scopes", f" select {_CLOSED}")),
    "r3_lock_uses_stream": (_r3_uses, fx.sql("locks", """, st as (select * from (select *, lag(kind, 1, 'lock_released') over (partition by stream_id, name order by date_ns, seq) was from locks where kind in ('lock_acquired', 'lock_released')) where kind <> was),
us as (select *, lead(date_ns) over (partition by stream_id, name order by date_ns, seq) as e from st)
select stream_id, name, thread_id, seq, date_ns as start_ns, e as end_ns, e - date_ns as held_ns from us where kind = 'lock_acquired' and e is not null""")),
    "r3_allocations_stream": (_r3_allocations, fx.sql("memory", """, al as (select *, lead(kind) over w as nk, lead(seq) over w as free_seq, lead(thread_id) over w as free_thread, lead(date_ns) over w as end_ns from memory window w as (partition by stream_id, ptr order by seq))
select stream_id, ptr::bigint as ptr, seq as alloc_seq, thread_id, size, date_ns as start_ns, free_seq, free_thread, end_ns from al where kind = 'alloc' and nk = 'dealloc'""")),
    "r4_select_stream": (_r4, fx.sql("attached", f", {_HIT}, {_UNDER} select * from hit union all select * from und")),
    "r5_late_rows": (_r5, fx.sql("scopes", f" select {_CLOSED}")),
    "r6_follow": (_r6, fx.sql("trace", " select stream_id, thread_id, seq, date_ns, kind, name from trace where date_ns >= (select max(date_ns) from trace) - 1000000000000000")),
    "e7_collect_stream": (_e7, fx.sql("scopes", f", {_HIT} select spec_id, stream_id, thread_id, seq from hit where seq <= (select max(f) from (select min(seq) f from hit group by spec_id))")),
}
