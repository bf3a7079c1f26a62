"""Typed readers for raw venue messages.

Each function takes a DataFrame with a string column ``value`` holding one JSON document (or log
line) per row, as ``spark.read.text`` / ``spark.readStream`` deliver it, so the same code
serves batch files and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.predicates import normalise_time

FILL_SCHEMA = (
    "proxyWallet string, name string, pseudonym string, side string, outcome string, price double, size double, "
    "timestamp long, transactionHash string, conditionId string, eventSlug string, asset string, title string, "
    "slug string, outcomeIndex int, bio string, profileImage string, profileImageOptimized string"
)
LEVEL = "struct<price:string,size:string>"
MESSAGE_SCHEMA = (
    "event_type string, asset_id string, market string, timestamp string, price string, size string, side string, "
    f"bids array<{LEVEL}>, asks array<{LEVEL}>, "
    "price_changes array<struct<asset_id:string,best_bid:string,best_ask:string>>, "
    "winning_outcome string, old_tick_size string, new_tick_size string"
)
LEAD_SCHEMA = (
    "kind string, coin string, epochMs double, p double, s string, sz double, "
    "bids array<struct<px:string,sz:string>>, asks array<struct<px:string,sz:string>>"
)
TRANSFER_SCHEMA = (
    "wallet string, from_address string, to_address string, value string, token_decimals int, "
    "token_symbol string, block_timestamp string"
)
SAMPLE_SCHEMA = (
    "slug string, samples array<struct<book_ok:boolean,best_ask_raw:double,best_bid_raw:double,trades_per_sec:double>>"
)
ATTRIBUTION_SCHEMA = (
    "ts_us long, reason string, expected_ev double, realized_pnl double, posterior_probability double, alpha double"
)


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    """One struct per JSON document, flattened; unreadable documents give null fields."""
    return raw.select(F.from_json("value", schema).alias("_j")).select("_j.*")


def fills(raw: DataFrame) -> DataFrame:
    """Identified fills; a row without transaction hash or wallet is dropped."""
    j = parsed(raw, FILL_SCHEMA)
    known = (F.coalesce("transactionHash", F.lit("")) != "") & (F.coalesce("proxyWallet", F.lit("")) != "")
    price, size = F.coalesce("price", F.lit(0.0)), F.coalesce("size", F.lit(0.0))
    return j.filter(known).select(
        F.substring(F.lower("proxyWallet"), 1, 42).alias("wallet"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("pseudonym", F.lit("")).alias("pseudonym"),
        F.coalesce("side", F.lit("")).alias("side"),
        F.coalesce("outcome", F.lit("")).alias("outcome"),
        price.alias("price"),
        size.alias("size"),
        F.round(size * price, 4).alias("usd"),
        (F.coalesce("timestamp", F.lit(0)) * 1000).alias("ts_us"),
        F.col("transactionHash").alias("tx_hash"),
        F.coalesce("conditionId", F.lit("")).alias("market_id"),
        F.coalesce("eventSlug", F.lit("")).alias("event_slug"),
        F.coalesce("asset", F.lit("")).alias("asset_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("slug", F.lit("")).alias("slug"),
        F.coalesce("outcomeIndex", F.lit(0)).alias("outcome_index"),
    )


def messages(raw: DataFrame) -> DataFrame:
    """Market messages with a resolved asset id and event time."""
    j = parsed(raw, MESSAGE_SCHEMA)
    return j.withColumn("asset_id", F.coalesce("asset_id", "market")).withColumn("ts_us", normalise_time(F.col("timestamp")))


def book_mids(msgs: DataFrame) -> DataFrame:
    """Mid of each full book message with a positive, uncrossed top."""
    top = msgs.filter("event_type = 'book'").select(
        "asset_id", "ts_us",
        F.expr("try_cast(get(bids, 0).price as double)").alias("bid"),
        F.expr("try_cast(get(asks, 0).price as double)").alias("ask"),
    )
    return top.filter((F.col("bid") > 0) & (F.col("ask") > F.col("bid"))).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def price_change_mids(msgs: DataFrame) -> DataFrame:
    """One quote per changed asset of each price-change message."""
    each = msgs.filter("event_type = 'price_change'").select("ts_us", F.explode("price_changes").alias("c"))
    return each.select(
        F.col("c.asset_id").alias("asset_id"), "ts_us",
        F.expr("try_cast(c.best_bid as double)").alias("bid"),
        F.expr("try_cast(c.best_ask as double)").alias("ask"),
    ).filter("bid is not null and ask is not null").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def last_trades(msgs: DataFrame) -> DataFrame:
    """Anonymous trade ticks with a size."""
    return (
        msgs.filter("event_type = 'last_trade_price'")
        .select(
            "asset_id", "ts_us", F.upper("side").alias("side"),
            F.expr("try_cast(price as double)").alias("price"), F.expr("try_cast(size as double)").alias("size"),
        )
        .filter(F.coalesce("size", F.lit(0.0)) != 0)
    )


def resolutions(msgs: DataFrame) -> DataFrame:
    return msgs.filter("event_type = 'market_resolved'").select("asset_id", "ts_us", "winning_outcome")


def tick_size_changes(msgs: DataFrame) -> DataFrame:
    return msgs.filter("event_type = 'tick_size_change'").select(
        "asset_id", "ts_us",
        F.expr("try_cast(old_tick_size as double)").alias("old_tick"),
        F.expr("try_cast(new_tick_size as double)").alias("new_tick"),
    )


def routed(msgs: DataFrame) -> DataFrame:
    """``kind, asset_id, ts_us, v``: what the readers above make of each kind (mid, size, new tick, or 1 if YES has won), all in one pass, so that a document is parsed once."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    one = lambda kind, asset, v: F.struct(F.lit(kind).alias("kind"), asset.alias("asset_id"), v.alias("v"))
    own, of = F.col("asset_id"), lambda name: F.col("event_type") == name
    bid, ask, size = number("get(bids, 0).price"), number("get(asks, 0).price"), number("size")
    quote = lambda c: (c["best_bid"].try_cast("double") + c["best_ask"].try_cast("double")) / 2
    changed = F.filter(F.transform("price_changes", lambda c: one("price_change", c["asset_id"], quote(c))), lambda x: x["v"].isNotNull())
    rows = (
        F.when(of("book") & (bid > 0) & (ask > bid), F.array(one("book", own, (bid + ask) / 2)))
        .when(of("price_change"), changed)
        .when(of("last_trade_price") & (F.coalesce(size, F.lit(0.0)) != 0), F.array(one("trade", own, size)))
        .when(of("tick_size_change"), F.array(one("tick_size", own, number("new_tick_size"))))
        .when(of("market_resolved"), F.array(one("resolved", own, (F.col("winning_outcome") == "YES").cast("double"))))
    )
    return msgs.select("ts_us", F.explode(rows).alias("_r")).select("_r.kind", "_r.asset_id", "ts_us", "_r.v")


def token_list(text: Column) -> Column:
    """Token ids from a JSON list or a list of lists."""
    nested = F.flatten(F.from_json(text, "array<array<string>>"))
    flat = F.from_json(text, "array<string>")
    ids = F.when(text.rlike(r"^\s*\[\s*\["), nested).otherwise(flat)
    return F.filter(ids, lambda x: F.coalesce(x, F.lit("")) != "")


def market_tokens(markets: DataFrame, order: str = "market_no") -> DataFrame:
    """One row per (market, outcome index, token); a token keeps its first market."""
    each = markets.select(order, "market_id", F.posexplode(token_list(F.col("token_ids"))).alias("outcome_index", "token_id"))
    first = each.groupBy("token_id").agg(F.min(F.struct(order, "outcome_index", "market_id")).alias("_m"))
    return first.select("_m.market_id", "_m.outcome_index", "token_id")


def lead_trades(raw: DataFrame) -> DataFrame:
    j = parsed(raw, LEAD_SCHEMA).filter("kind = 'trade' and p > 0 and sz > 0 and epochMs > 0")
    return j.select(
        "coin", (F.col("epochMs") * 1000).cast("long").alias("ts_us"), F.upper("s").alias("side"),
        F.col("p").alias("price"), F.col("sz").alias("size"), (F.col("p") * F.col("sz")).alias("notional"),
    )


def lead_mids(raw: DataFrame) -> DataFrame:
    j = parsed(raw, LEAD_SCHEMA).filter("kind = 'book'")
    top = j.select(
        "coin", (F.col("epochMs") * 1000).cast("long").alias("ts_us"),
        F.expr("try_cast(get(bids, 0).px as double)").alias("bid"), F.expr("try_cast(get(asks, 0).px as double)").alias("ask"),
    )
    return top.filter("bid > 0 and ask > 0").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def transfer_history(raw: DataFrame, rows_per_wallet: int | None = None) -> DataFrame:
    """Token transfers as history rows, or the newest ``rows_per_wallet`` of each wallet."""
    from tapewatch.operators.sequence import top_per_key

    j = parsed(raw, TRANSFER_SCHEMA)
    rows = j.select(
        F.substring(F.lower("wallet"), 1, 42).alias("wallet"),
        normalise_time(F.col("block_timestamp")).alias("ts_us"),
        F.when(F.lower("to_address") == F.lower("wallet"), "BUY").otherwise("SELL").alias("side"),
        F.abs(F.expr("coalesce(try_cast(value as double), 0)") / F.pow(F.lit(10.0), F.coalesce("token_decimals", F.lit(6)))).alias("size"),
        F.coalesce("token_symbol", F.lit("erc20")).alias("market_id"),
    )
    return top_per_key(rows, "wallet", [F.desc("ts_us"), F.desc("size"), F.asc("side")], rows_per_wallet) if rows_per_wallet else rows


def once_per_event(envelopes: DataFrame) -> DataFrame:
    """Idempotent ingest: the earliest received envelope of each event id."""
    rest = [c for c in envelopes.columns if c != "event_id"]
    kept = envelopes.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct("received_us", *rest)).alias("_e"))
    return kept.select("event_id", *[F.col(f"_e.{c}").alias(c) for c in rest])


def cluster_map(raw: DataFrame) -> DataFrame:
    """Market-to-cluster rows from JSON maps, keeping non-empty cluster ids."""
    each = raw.select(F.explode(F.from_json("value", "map<string,struct<cluster_id:string,internal_direction:int>>")).alias("market_id", "c"))
    return each.filter(F.coalesce("c.cluster_id", F.lit("")) != "").select(
        "market_id", "c.cluster_id", F.coalesce("c.internal_direction", F.lit(1)).alias("internal_direction")
    )


def address_list(raw: DataFrame) -> DataFrame:
    """Lower-cased distinct addresses from a text file with comments."""
    text = F.lower(F.trim(F.regexp_replace("value", "#.*$", "")))
    return raw.select(F.substring(text, 1, 42).alias("address")).filter("address like '0x%'").distinct()


def lead_market_map(raw: DataFrame) -> DataFrame:
    """Coin-to-market rows from a JSON map of lists."""
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("coin", "ms")).select(
        "coin", F.explode("ms").alias("market_id")
    )


def attribution_records(raw: DataFrame) -> DataFrame:
    return parsed(raw, ATTRIBUTION_SCHEMA)


def log_metrics(raw: DataFrame, since_us: int) -> DataFrame:
    """Trade ticks and entropy fires per tier from log lines stamped at or after ``since_us``."""
    stamp = F.try_to_timestamp(F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    tier = F.regexp_extract("value", r"tier=(t[1235])", 1)
    lines = raw.filter(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}")).filter(F.unix_micros(stamp) >= since_us)
    ticks = F.col("value").contains("[DIAG][TRADE_TICK]") | F.col("value").contains("last_trade_price")
    fires = F.col("value").contains("ENTROPY_FIRE")
    queued = F.col("value").contains("queue.put") | F.col("value").contains("signal_queue") | F.col("value").contains("[SE][QUEUE]")
    return lines.groupBy(F.when(tier == "", "t3").otherwise(tier).alias("tier")).agg(
        F.count_if(ticks).alias("trade_ticks"), F.count_if(fires).alias("entropy_fires"), F.count_if(queued).alias("queue_puts")
    )


def window_samples(raw: DataFrame) -> DataFrame:
    return parsed(raw, SAMPLE_SCHEMA).select("slug", F.explode("samples").alias("s")).select("slug", "s.*")


def trade_addresses(raw_trades: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct address found in the given columns, in column order."""
    cleaned = [F.when(F.col(c).startswith("0x") & (F.length(c) >= 42), F.substring(F.lower(F.col(c)), 1, 42)) for c in columns]
    found = F.array_distinct(F.array_compact(F.array(*cleaned)))
    return raw_trades.select("*", F.posexplode(found).alias("address_no", "address"))
