"""Sums, keys and batches larger than the given tables have."""

from decimal import Decimal

import duckdb
import pytest

from spanlake.operators import locks, profile


def test_flat_profile_of_sums_beyond_a_long(spark):
    cols = "stream_id long, thread_id long, path array<string>, calls long, value long, self long"
    big = (1 << 62) + 1
    rows = [(0, i, ["a"], 1, big, big) for i in range(3)] + [(0, 9, ["b"], 2, 7, 7)]
    got = {r.name: r for r in profile.flat_profile(spark.createDataFrame(rows, cols)).collect()}
    assert (got["a"].self, got["a"].incl, got["a"].calls, got["b"].self) == (Decimal(3 * big), Decimal(3 * big), 3, 7)
    assert (got["a"].self_pct, got["b"].self_pct) == (100.0, 0.0)
    small = profile.flat_profile(spark.createDataFrame(rows[-1:], cols))
    assert dict(small.dtypes)["self"] == dict(small.dtypes)["incl"] == "bigint" and small.first().self == 7


def test_lock_stats_of_sums_beyond_a_long(spark):
    uses = spark.createDataFrame([(0, "l", 1)], "stream_id long, name string, held_ns long")
    waits = spark.createDataFrame([(0, "l", 1 << 62)] * 3, "stream_id long, name string, wait_ns long")
    r = locks.lock_stats(uses, waits).first()
    assert (r.total_held, r.total_wait, r.waits) == (1, 3 << 62, 3)


def test_dates_that_go_back_and_many_keys_a_slot(spark, tmp_path, monkeypatch):
    """Two copies of a trace one after another: the second begins at the first date again; all threads share two slots."""
    from pyspark.sql import functions as F

    from spanlake.operators import scopes
    from spanlake.plans import fixtures as fx
    from spanlake.plans import live_catalog as lc
    from spanlake.streaming import live

    t = fx.trace(spark, "/root/testdata/sf0.001")
    t = t.unionByName(t.withColumns({"seq": F.col("seq") + 1000, "thread_id": F.col("thread_id") + 1000}))
    monkeypatch.setattr(lc, "FILE_ROWS", 100)  # several files a part
    monkeypatch.setattr(live._stateful, "__defaults__", (2,))
    rows, delay = lc.disordered(t)
    got = lc.finished(live.pair_scopes_stream(lc.arrive(rows, "late", "_part", 8)[1], watermark=("ts", delay)), "pairs")
    want = scopes.pair_scopes(t).where("not is_open").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


FIRST = "case when ts = (select min(ts) from '/root/testdata/sf0.001/events.parquet') then 'view' else event_type end as event_type"
DEALT = "timestamp '2024-01-01' + cast(hash(event_id, c) % 10000 as int) * interval 1 minute as ts"


@pytest.mark.parametrize(
    ("name", "change"),
    [("r5_late_rows", FIRST), ("r5_late_rows", ""), ("r5_late_rows", DEALT), ("r2_pair_stream", "")],
    ids=["first row begins a scope", "dates begin again", "dates in no order", "dates begin again, no watermark"],
)
def test_live_pairs_of_odd_dates_equal_sql(spark, tmp_path, name, change):
    """Three copies of the events one after another, of the same users and dates: every thread goes back to its first date."""
    from spanlake.plans.live_catalog import LIVE

    path = str(tmp_path / "events.parquet")
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    changes = ", ".join(filter(None, ["event_id + 1000 * c as event_id", "user_id + 1000 * c as user_id" * (change == FIRST), change]))
    db.execute(f"copy (select e.* replace ({changes}) from '/root/testdata/sf0.001/events.parquet' e, range(3) r(c)) to '{path}'")
    db.execute(f"create view events as select * from '{path}'")
    query, sql = LIVE[name]
    got = query(spark, str(tmp_path))
    want = db.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    assert any(r[5] == 0 for r in want) if change == FIRST else any(r[7] < 0 for r in want)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_wait_until_the_watermark_has_passed_their_microseconds(spark, tmp_path, monkeypatch):
    from spanlake.streaming import live

    monkeypatch.setattr(live._stateful, "__defaults__", (1,))  # a row of another thread wakes the slot
    cols = "stream_id long, thread_id long, seq long, date_ns long, kind string, name string, us long"
    s = 10**9
    for rows in ([(0, 1, 2, 2, "scope_end", "a", s + 5900), (0, 2, 0, 0, "data", "d", s + 1000)], [(0, 2, 1, 1, "data", "d", s + 5200)], [(0, 1, 1, 1, "scope_begin", "a", s + 5500)], [(-1, -1, 9, 9, "data", "t", 9 * s)]):
        d = spark.createDataFrame(rows, cols).selectExpr("*", "timestamp_micros(us) as ts")
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "i"))
    sdf = live.pair_scopes_stream(live.read_live(spark, str(tmp_path / "i"), d.schema, 1), watermark=("ts", "0 seconds"))
    q = sdf.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.scope_id, r.end_ns) for r in spark.read.schema(sdf.schema).parquet(str(tmp_path / "o")).collect()] == [(1, 2)]


def test_collisions_are_counted_without_their_strings(spark):
    from spanlake.sources import strings

    names = ["costarring", "liquid", "declinate", "macallums", "alone", "liquid", "é", ""]  # known pairs of 32 bits
    d = spark.createDataFrame([(x,) for x in [*names, None]], "x string")
    words, shared = strings.build_dictionary(d, "x", bits=32)
    got = {(r.hash, r.n) for r in strings.count_collisions(d, "x", bits=32).collect()}
    assert len(got) == 2 and got == {(r.hash, len(r["values"])) for r in shared.collect()}
    assert {r.value: r.hash for r in words.where("value in ('', 'é')").collect()} == {"": "00000000811C9DC5", "é": f"{int(strings.fnv1a(['é'], 32)[0]):016X}"}


def test_contention_is_dealt_to_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(locks, "TASK_ROWS", 4)
    waits = spark.createDataFrame([(0, "l", i, i, i, i + 50, 50) for i in range(60)], "stream_id long, name string, thread_id long, seq long, start_ns long, end_ns long, wait_ns long")
    uses = spark.createDataFrame([(0, "l", 1000 + i, i, 2 * i, 2 * i + 2) for i in range(60)], "stream_id long, name string, thread_id long, seq long, start_ns long, end_ns long")
    got = locks.contention(waits, uses, bucket_ns=16, min_wait_ns=0)
    want = {(w, u) for w in range(60) for u in range(60) if 2 * u < w + 50 and 2 * u + 2 > w}
    rows = got.collect()
    assert {(r.wait_seq, r.use_seq) for r in rows} == want and len(rows) == len(want)
    assert got.rdd.getNumPartitions() == 60  # two joins of 120 rows, four rows a task


def test_the_network_is_fitted_on_all_training_documents(spark):
    from pyspark.sql import functions as F

    from spanlake.llm import lm
    from spanlake.llm.tokens import word_bpe_path

    docs = spark.createDataFrame([(i, f"word number {i}") for i in range(40)], "doc_id long, text string")
    shards = lm.shard_texts(docs, word_bpe_path(), 1000.0, lm.SHARE, 2, 500)
    assert shards.agg(F.sum(F.octet_length("lens") / 4)).first()[0] == 40
