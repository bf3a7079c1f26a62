"""Structured Streaming jobs: sources, windowed aggregates, joins, dedupe and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators.lineage import checkpoint_folder
from tapewatch.operators.microstructure import order_type
from tapewatch.operators.sequence import US
from tapewatch.streaming import processors as P

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def interval(us: int) -> str:
    return f"{us // 1000} milliseconds"


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Rows of Parquet files as they arrive; column ``ts`` becomes a UTC instant."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def with_event_time(df: DataFrame, delay_us: int) -> DataFrame:
    """Event-time column ``at`` from ``ts_us`` with a watermark."""
    return df.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", interval(delay_us))


def closed(stream: DataFrame, at_us: int = 4_102_444_800_000_000) -> DataFrame:
    """The stream with one row of empty fields at ``at_us`` (year 2100), which moves the watermark past the end of a finished input.

    Windows of real rows then close and are written; the row's own window stays open. For replays of stored input only.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(stream)}/closing-{uuid.uuid4().hex}"
    fields = [F.lit(at_us if f.name == "ts_us" else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*fields).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def run_available(stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """Process everything available, then return what the query wrote.

    Output and progress go to new folders in the session's checkpoint folder, or to ``root``, where a later run goes on.
    """
    root = root or f"{checkpoint_folder(stream)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def stateful(stream: DataFrame, keys: list[str], processor, time_mode: str = "None") -> DataFrame:
    """Run a keyed state processor; states live in RocksDB, so they may outgrow memory."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode=time_mode
    )


def time_mode(ttl_ms: int | None) -> str:
    return "ProcessingTime" if ttl_ms else "None"


def entropy_signals(ticks: DataFrame, window_us: int = 5 * US) -> DataFrame:
    return stateful(ticks.select("asset_id", "event_id", "ts_us", "side", "size"), ["asset_id"], P.EntropyDetector(window_us))


def flow_shocks(lead: DataFrame, window_us: int = 100_000, min_notional: float = 500.0, imbalance: float = 0.6, gap_us: int = 5 * US) -> DataFrame:
    rows = lead.select("coin", "event_id", "ts_us", "side", "price", "size")
    return stateful(rows, ["coin"], P.FlowShockDetector(window_us, min_notional, imbalance, gap_us))


def arbitrage_legs(asks: DataFrame, max_total: float = 0.97, min_depth: float = 50.0, ttl_us: int = 24 * 3600 * US) -> DataFrame:
    rows = asks.select("market_id", "event_id", "ts_us", "outcome", "ask", "ask_size", "at")
    return stateful(rows, ["market_id"], P.ArbitrageLegs(max_total, min_depth, ttl_us), "EventTime")


def cooldown_triggers(trades: DataFrame, min_usd: float = 500.0, cooldown_us: int = 2 * US, ttl_ms: int | None = None) -> DataFrame:
    """Small trades are dropped before the shuffle. ``ttl_ms`` (of processing time) needs a trigger that runs on, not one that ends."""
    rows = trades.filter(F.col("usd") >= min_usd).select("market_id", "event_id", "ts_us", "usd")
    return stateful(rows, ["market_id"], P.Cooldown(min_usd, cooldown_us, ttl_ms), time_mode(ttl_ms))


def first_alerts(alerts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return stateful(alerts.select("alert_key", "event_id", "ts_us"), ["alert_key"], P.FirstAlert(ttl_ms), time_mode(ttl_ms))


def order_sessions(fills: DataFrame, gap_us: int = 30 * US) -> DataFrame:
    """Closed order sessions (batch twin: reconstruct_orders)."""
    s = fills.groupBy("wallet", "market_id", "side", F.session_window("at", interval(gap_us)).alias("w")).agg(
        F.sum("usd").alias("total_usd"), (F.sum(F.col("usd") * F.col("price")) / F.sum("usd")).alias("avg_price"), F.count(F.lit(1)).alias("fill_count"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    )
    return s.drop("w").withColumn("order_type", order_type(F.col("fill_count"), F.col("last_us") - F.col("first_us")))


def market_windows(trades: DataFrame, width_us: int = 300 * US) -> DataFrame:
    """Tumbling per-market volume and trade counts."""
    w = trades.groupBy("market_id", F.window("at", interval(width_us)).alias("w")).agg(F.count(F.lit(1)).alias("trades"), F.sum("usd").alias("usd"))
    return w.select("market_id", F.unix_micros("w.start").alias("window_us"), "trades", "usd")


def rate_counters(trades: DataFrame, width_us: int = 60 * US, step_us: int = 5 * US) -> DataFrame:
    """Sliding event counts per tier or type."""
    w = trades.groupBy("event_type", F.window("at", interval(width_us), interval(step_us)).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return w.select("event_type", F.unix_micros("w.start").alias("window_us"), "events")


def signals_with_observations(signals: DataFrame, observations: DataFrame, lookback_us: int = 1800 * US, grace_us: int = 8 * US) -> DataFrame:
    """Stream-stream interval join: observations in the lookback before a signal or in its grace period."""
    o = observations.select(F.col("market_id").alias("o_market"), F.col("at").alias("o_at"), "address", "obs_id")
    near = (F.col("o_at") >= F.col("at") - F.expr(f"INTERVAL '{lookback_us // US}' SECOND")) & (
        F.col("o_at") <= F.col("at") + F.expr(f"INTERVAL '{grace_us // US}' SECOND")
    )
    return signals.join(o, (F.col("market_id") == F.col("o_market")) & near).select("signal_id", "market_id", "address", "obs_id")


def once(df: DataFrame, key: str) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark delay."""
    return df.dropDuplicatesWithinWatermark([key])


def upsert_sink(stream: DataFrame, merge, table_root: str) -> DataFrame:
    """Run a stream into a versioned keyed table.

    ``merge(old_or_none, batch) -> DataFrame`` builds the next version. Each batch id writes its
    own version folder from the newest complete version below it, so a retried batch rewrites the
    same folder and a restarted query goes on from the stored table.
    """
    from tapewatch.sources import sinks as K

    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        prior = K.newest_version(session, table_root, before=batch_id)
        old = None if prior is None else K.read_version(session, table_root, prior)
        K.write_version(merge(old, batch), table_root, batch_id)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{table_root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return K.read_version(spark, table_root, K.newest_version(spark, table_root))
