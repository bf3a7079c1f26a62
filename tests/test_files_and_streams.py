"""File sources and sinks, and streams fed by several files against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import microstructure as M
from tapewatch.operators.sequence import HOUR
from tapewatch.sources import readers as R
from tapewatch.sources import sinks as K
from tapewatch.sources.bindings import bind
from tapewatch.streaming import jobs as S

FOLDER = "/root/testdata/sf0.001"


def test_attribution_json_append_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r", 0.5, 1.0, 0.6, 0.25)], R.ATTRIBUTION_SCHEMA)
    path = str(tmp_path / "log")
    K.append_json(rows, path)
    K.append_json(rows.withColumn("ts_us", F.lit(2).cast("long")), path)
    got = R.attribution_records(spark.read.text(path)).orderBy("ts_us").collect()
    assert [r.ts_us for r in got] == [1, 2] and got[0].reason == "r"


def test_unreadable_json_gives_nulls_not_errors(spark):
    raw = spark.createDataFrame([("not json",), ('{"transactionHash": "0x1"}',), ('{"transactionHash":"0x1","proxyWallet":"0xAB","price":"0.5","size":2}',)], "value string")
    assert [r.wallet for r in R.fills(raw).collect()] in (["0xab"], [])
    assert R.cluster_map(raw).count() == 0


def test_versioned_upsert_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1, 5, 1)], "k string, at long, best long, n long")
    new = spark.createDataFrame([("a", 2, 3, 0), ("b", 2, 9, 0)], "k string, at long, best long, n long")
    policy = {"best": K.MAXIMUM, "n": K.COUNTER}
    K.write_version(old, root, 0)
    for _ in range(2):
        K.write_version(K.upsert(K.read_version(spark, root, 0), new, ["k"], policy, "at"), root, 1)
    got = {r.k: (r.at, r.best, r.n) for r in K.read_version(spark, root, 1).collect()}
    assert got == {"a": (2, 5, 2), "b": (2, 9, 1)}


def test_purge_splits_rows(spark):
    df = spark.range(10)
    kept, bad, counts = K.purge(df, F.col("id") < 3)
    assert kept.count() == 7 and bad.count() == 3 and counts.collect()[0].purged == 3


@pytest.fixture()
def split_trades(spark, tmp_path):
    """The trades in time order as four files, one per trigger."""
    trades = bind(spark, FOLDER, "trades").orderBy("ts_us")
    edges = [r[0] for r in trades.selectExpr("percentile_approx(ts_us, array(0.25, 0.5, 0.75), 10000) as q").collect()][0]
    part = sum(((F.col("ts_us") > e).cast("int") for e in edges), F.lit(0))
    path = tmp_path / "in"
    for i in range(4):
        trades.filter(part == i).coalesce(1).write.mode("append").parquet(str(path))
        import time

        time.sleep(1.1)  # the file source orders files by modification time in seconds
    return spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(str(path)), trades


def test_entropy_stream_equals_batch(spark, split_trades):
    stream, trades = split_trades
    key = lambda df: df.withColumn("asset_id", F.col("market_id"))
    out = S.run_available(S.entropy_signals(key(stream), 12 * HOUR)).filter("not late and entropy is not null")
    got = {r.event_id: (round(r.entropy, 6), None if r.z is None else round(r.z, 4)) for r in out.collect()}
    z = M.entropy_zscore(M.rolling_entropy(key(trades), 12 * HOUR))
    want = {r.event_id: (round(r.entropy, 6), None if r.z is None else round(r.z, 4)) for r in z.collect()}
    assert got == want


def test_cooldown_stream_equals_batch(spark, split_trades):
    stream, trades = split_trades
    got = {r.event_id for r in S.run_available(S.cooldown_triggers(stream, 5.0, 6 * HOUR)).collect()}
    want = {r.event_id for r in M.cooldown_triggers(trades, 5.0, 6 * HOUR, 48 * HOUR).collect()}
    assert got == want


def test_upsert_stream_counts_every_row_once(spark, split_trades, tmp_path):
    stream, trades = split_trades

    def merge(old, batch):
        rows = batch.select("wallet", F.col("ts_us").alias("at"), F.lit(0).cast("long").alias("n"))
        return K.upsert(rows.limit(0) if old is None else old, rows, ["wallet"], {"n": K.COUNTER}, "at")

    table = str(tmp_path / "table")
    S.upsert_sink(stream, merge, table)
    # A restart without new files goes on from the stored table.
    got = {r.wallet: r.n for r in S.upsert_sink(stream, merge, table).collect()}
    want = {r.wallet: r["count"] for r in trades.groupBy("wallet").count().collect()}
    assert got == want


def test_equal_times_and_late_rows(spark, tmp_path):
    """Rows of one instant all count; rows behind the cursor come out as late, also after a restart."""
    schema = "event_id long, ts_us long, asset_id string, side string, size double"
    first = [(1, 100, "a", "BUY", 1.0), (2, 100, "a", "SELL", 3.0), (3, 200, "a", "BUY", 2.0), (4, 200, "a", "SELL", 2.0), (5, 300, "b", "BUY", 1.0)]
    later = [(6, 150, "a", "BUY", 9.0), (7, 200, "a", "BUY", 4.0), (8, 250, "a", "SELL", 1.0)]
    for rows in (first, later):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = S.run_available(S.entropy_signals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1000), root=f"{tmp_path}/run")
    got = {r.event_id: (r.late, None if r.entropy is None else round(r.entropy, 4)) for r in out.collect()}
    assert {k for k, v in got.items() if v[0]} == {6} and len(got) == 8
    assert got[1] == got[2] == (False, 0.8113) and got[3] == got[4] and got[7][1] is not None
    batch = M.rolling_entropy(spark.createDataFrame(first, schema), 1000)
    assert all(got[r.event_id][1] == (None if r.entropy is None else round(r.entropy, 4)) for r in batch.collect())


def test_both_legs_of_one_instant(spark, tmp_path):
    rows = [(1, 100, "m", "YES", 0.4, 90.0), (2, 100, "m", "NO", 0.5, 80.0), (3, 90, "m", "NO", 0.1, 80.0)]
    schema = "event_id long, ts_us long, market_id string, outcome string, ask double, ask_size double"
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: S.run_available(S.arbitrage_legs(S.with_event_time(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 10**9)), root=f"{tmp_path}/run")
    assert [(r.event_id, r.total, r.late) for r in run().collect()] == [(2, 0.9, False)]
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted((r.event_id, r.late) for r in run().collect()) == [(2, False), (3, True)]


def test_windows_close_at_the_end_of_a_replay(spark, tmp_path):
    schema = "event_id long, ts_us long, market_id string, usd double"
    spark.createDataFrame([(1, 10**15, "m", 2.0), (2, 10**15 + 1, "m", 3.0)], schema).write.parquet(f"{tmp_path}/in")
    stream = S.closed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    out = S.run_available(S.market_windows(S.with_event_time(stream, 3_600_000_000), 300_000_000)).collect()
    assert [(r.market_id, r.trades, r.usd) for r in out] == [("m", 2, 5.0)]


def test_messages_are_routed_in_one_pass(spark):
    docs = [
        '{"event_type": "book", "asset_id": "a", "timestamp": "1706659200000", "bids": [{"price": "0.4", "size": "1"}], "asks": [{"price": "0.5", "size": "1"}]}',
        '{"event_type": "book", "asset_id": "crossed", "timestamp": "1706659200000", "bids": [{"price": "0.6", "size": "1"}], "asks": [{"price": "0.5", "size": "1"}]}',
        '{"event_type": "book", "asset_id": "empty", "timestamp": "1706659200000", "bids": [], "asks": []}',
        '{"event_type": "price_change", "timestamp": "1706659200000", "price_changes": [{"asset_id": "b", "best_bid": "0.2", "best_ask": "0.4"}, {"asset_id": "c", "best_bid": "x", "best_ask": "0.4"}]}',
        '{"event_type": "last_trade_price", "market": "d", "timestamp": "1706659200000", "price": "0.3", "size": "7", "side": "buy"}',
        '{"event_type": "last_trade_price", "asset_id": "none", "timestamp": "1706659200000", "price": "0.3"}',
        '{"event_type": "tick_size_change", "asset_id": "e", "timestamp": "1706659200000", "old_tick_size": "0.01"}',
        '{"event_type": "market_resolved", "asset_id": "f", "timestamp": "1706659200000", "winning_outcome": "YES"}',
        '{"event_type": "other", "asset_id": "g"}', "broken", None,
    ]
    msgs = R.messages(spark.createDataFrame([(d,) for d in docs], "value string"))
    out = R.routed(msgs)
    got = {(r.kind, r.asset_id, round(r.v, 6) if r.v is not None else None) for r in out.collect()}
    assert got == {("book", "a", 0.45), ("price_change", "b", 0.3), ("trade", "d", 7.0), ("tick_size", "e", None), ("resolved", "f", 1.0)}
    old = [(R.book_mids, "book", "mid"), (R.price_change_mids, "price_change", "mid"), (R.last_trades, "trade", "size"), (R.tick_size_changes, "tick_size", "new_tick")]
    for read, kind, value in old:
        same = out.filter(F.col("kind") == kind).select("asset_id", "ts_us", "v").collect()
        assert sorted(same) == sorted(read(msgs).select("asset_id", "ts_us", value).collect())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
