"""Trace tables derived from the ``events`` table, in Spark and as common table expressions of DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = ["stream_id", "thread_id"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "*",
        (F.col("user_id") % 4).alias("stream_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("abs_ns"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def _dated(b: DataFrame) -> DataFrame:
    origin = b.agg(F.min("abs_ns").alias("origin"))
    return b.join(F.broadcast(origin)).withColumn("date_ns", F.col("abs_ns") - F.col("origin"))  # one row


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _dated(base(spark, sf_dir))
    kind = F.col("event_type")
    op = F.concat(F.lit("op"), (F.col("k") % 3).cast("string"))
    return b.select(
        "stream_id",
        F.col("user_id").alias("thread_id"),
        F.col("event_id").alias("seq"),
        "date_ns",
        F.when(kind.isin("signup", "view"), "scope_begin").when(kind.isin("purchase", "click"), "scope_end").otherwise("data").alias("kind"),
        F.when(kind.isin("signup", "view"), op)
        .when(kind == "error", F.concat(F.lit("m"), (F.col("k") % 2).cast("string")))
        .when(F.col("k") % 4 == 0, "")
        .otherwise(op)
        .alias("name"),
        F.when(kind == "error", F.col("value")).alias("v_double"),
    )


FORMATS = {"f0": "n=%d", "f1": "n=%03d v=%.2f", "f2": "%-6d|%g", "f3": "hex %X"}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _dated(base(spark, sf_dir)).select(
        "stream_id",
        F.col("user_id").alias("thread_id"),
        F.col("event_id").alias("seq"),
        "date_ns",
        F.col("event_type").alias("category"),
        F.when(v < 25, 0).when(v < 50, 1).when(v < 100, 2).otherwise(3).alias("log_level"),
        F.concat(F.lit("f"), (F.col("k") % 4).cast("string")).alias("format"),
        F.col("k").alias("p0"),
        v.alias("p1"),
    )


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _dated(base(spark, sf_dir)).where("event_type <> 'error'")
    t = F.col("event_type")
    return b.select(
        F.concat(F.lit("lock"), (F.col("k") % 5).cast("string")).alias("name"),
        "stream_id",
        F.col("user_id").alias("thread_id"),
        F.col("event_id").alias("seq"),
        "date_ns",
        F.when(t == "signup", "lock_wait_begin").when(t == "view", "lock_notified").when(t == "click", "lock_acquired").when(t == "purchase", "lock_released").alias("kind"),
    )


def cswitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return _dated(base(spark, sf_dir)).select(
        "stream_id",
        F.col("event_id").alias("seq"),
        "date_ns",
        (F.col("k") % 4).alias("core"),
        F.when(t == "error", F.lit(-1)).when(t == "view", F.lit(-2)).otherwise(F.col("user_id")).cast("long").alias("runner"),
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = F.col("event_type").isin("purchase", "error")
    return _dated(base(spark, sf_dir)).select(
        "stream_id",
        F.col("user_id").alias("thread_id"),
        F.col("event_id").alias("seq"),
        "date_ns",
        F.col("k").alias("ptr"),
        F.when(free, "dealloc").otherwise("alloc").alias("kind"),
        F.when(~free, F.round(F.col("value") * 100).cast("long")).alias("size"),
    )


_B = """b as (select *, user_id % 4 as stream_id, epoch_us(ts) * 1000 as abs_ns,
  cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
dated as (select *, abs_ns - (select min(abs_ns) from b) as date_ns from b)"""
_TRACE = """trace as (select stream_id, user_id as thread_id, event_id as seq, date_ns,
  case when event_type in ('signup','view') then 'scope_begin'
       when event_type in ('purchase','click') then 'scope_end' else 'data' end as kind,
  case when event_type in ('signup','view') then concat('op', k % 3)
       when event_type = 'error' then concat('m', k % 2)
       when k % 4 = 0 then '' else concat('op', k % 3) end as name,
  case when event_type = 'error' then value end as v_double from dated)"""
_LOGS = """logs as (select stream_id, user_id as thread_id, event_id as seq, date_ns, event_type as category,
  case when value < 25 then 0 when value < 50 then 1 when value < 100 then 2 else 3 end as log_level,
  concat('f', k % 4) as format, k as p0, value as p1 from dated)"""
_LOCKS = """locks as (select concat('lock', k % 5) as name, stream_id, user_id as thread_id, event_id as seq, date_ns,
  case event_type when 'signup' then 'lock_wait_begin' when 'view' then 'lock_notified'
                  when 'click' then 'lock_acquired' when 'purchase' then 'lock_released' end as kind
  from dated where event_type <> 'error')"""
_CSWITCH = """cswitch as (select stream_id, event_id as seq, date_ns, k % 4 as core,
  case when event_type = 'error' then -1 when event_type = 'view' then -2 else user_id end::bigint as runner from dated)"""
_MEMORY = """memory as (select stream_id, user_id as thread_id, event_id as seq, date_ns, k as ptr,
  case when event_type in ('purchase','error') then 'dealloc' else 'alloc' end as kind,
  case when event_type not in ('purchase','error') then cast(round(value * 100) as bigint) end as size from dated)"""
_SCOPES = """s1 as (select *, sum(case kind when 'scope_begin' then 1 when 'scope_end' then -1 else 0 end)
         over (partition by stream_id, thread_id order by seq) as s from trace),
s2 as (select *, least(0, coalesce(min(s) over (partition by stream_id, thread_id order by seq
         rows between unbounded preceding and 1 preceding), 0)) as mp from s1),
s3 as (select *, s < mp as orphan, s - least(mp, s) as depth,
         case kind when 'scope_begin' then s - least(mp, s) - 1 else s - least(mp, s) end as lvl from s2),
s4 as (select *, lead(seq) over w as nseq, lead(date_ns) over w as ndate, lead(name) over w as nname
         from s3 where kind <> 'data' and not orphan window w as (partition by stream_id, thread_id, lvl order by seq)),
last_ns as (select stream_id, max(date_ns) as last_ns from trace group by 1),
sc as (select s4.stream_id, thread_id, seq as scope_id, lvl as level, name, date_ns as start_ns,
         coalesce(ndate, last_ns) as end_ns, coalesce(ndate, last_ns) - date_ns as duration_ns, nseq is null as is_open,
         coalesce(nseq, 9223372036854775807) as end_seq, nname as end_name,
         coalesce(nname <> '' and nname <> name, false) as mismatch
       from s4 join last_ns using (stream_id) where kind = 'scope_begin'),
par as (select c.*, (select max(p.scope_id) from sc p where p.stream_id = c.stream_id and p.thread_id = c.thread_id
         and p.level = c.level - 1 and p.scope_id < c.scope_id) as parent_id from sc c),
paths as (with recursive r as (select *, name as path from par where level = 0
         union all select c.*, r.path || '/' || c.name from par c join r on c.stream_id = r.stream_id
           and c.thread_id = r.thread_id and c.parent_id = r.scope_id and c.level = r.level + 1) select * from r)"""
_ATTACHED = """att as (select t.stream_id, t.thread_id, t.seq, t.date_ns, t.name, t.v_double, t.depth,
         (select max(p.scope_id) from sc p where p.stream_id = t.stream_id and p.thread_id = t.thread_id
           and p.level = t.depth - 1 and p.scope_id < t.seq) as parent_id from s3 t where kind = 'data')"""
CTE = {"trace": [_TRACE], "logs": [_LOGS], "locks": [_LOCKS], "cswitch": [_CSWITCH], "memory": [_MEMORY], "scopes": [_TRACE, _SCOPES], "attached": [_TRACE, _SCOPES, _ATTACHED]}


def sql(needs: str, body: str) -> str:
    """``body`` with the expressions that it needs before it."""
    parts: list[str] = [_B]
    for n in needs.split():
        parts += [p for p in CTE[n] if p not in parts]
    return "with " + ",\n".join(parts) + body
