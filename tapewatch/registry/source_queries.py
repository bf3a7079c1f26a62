"""Registered source and sink queries."""

import uuid

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators.lineage import checkpoint_folder
from tapewatch.operators import predicates as P
from tapewatch.sources import readers as R
from tapewatch.sources import sinks as K
from tapewatch.sources.bindings import AS_OF_US, DAY_US

MS = "ts_us div 1000"
MS_SQL = "(ts_us // 1000)"


@query("s1_fill_source", f"""SELECT wallet, side, outcome, price, size, round(size * price, 4) AS usd, {MS_SQL} * 1000 AS ts_us, tx_hash, market_id, asset_id
 FROM trades WHERE event_id % 10 <> 0 AND event_id % 11 <> 0""")
def _(t):
    doc = F.struct(
        F.upper("wallet").alias("_u"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("wallet")).alias("proxyWallet"),
        "side", "outcome", "price", "size", F.expr(MS).alias("timestamp"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("tx_hash")).alias("transactionHash"),
        F.col("market_id").alias("conditionId"), F.col("asset_id").alias("asset"),
    )
    raw = t.trades.select(F.to_json(doc).alias("value"))
    return R.fills(raw).select("wallet", "side", "outcome", "price", "size", "usd", "ts_us", "tx_hash", "market_id", "asset_id")


def raw_messages(t):
    """Market messages as JSON documents, one kind per event type."""
    p, q = F.col("price").cast("string"), (F.col("price") + 0.04).cast("string")
    level = lambda x: F.array(F.struct(x.alias("price"), F.lit("10").alias("size")))
    kind = (
        F.when(F.col("event_type") == "view", "book").when(F.col("event_type") == "click", "price_change")
        .when(F.col("event_type") == "purchase", "last_trade_price").when(F.col("event_type") == "signup", "tick_size_change")
        .otherwise("market_resolved")
    )
    doc = F.struct(
        kind.alias("event_type"), "asset_id", F.expr(MS).cast("string").alias("timestamp"),
        p.alias("price"), F.col("size").cast("string").alias("size"), F.lower("side").alias("side"),
        F.when(kind == "book", level(p)).alias("bids"), F.when(kind == "book", level(q)).alias("asks"),
        F.when(kind == "price_change", F.array(
            F.struct("asset_id", p.alias("best_bid"), q.alias("best_ask")),
            F.struct(F.concat("asset_id", F.lit("*")).alias("asset_id"), p.alias("best_bid"), F.lit(None).cast("string").alias("best_ask")),
            F.struct(F.concat("asset_id", F.lit("#")).alias("asset_id"), p.alias("best_bid"), p.alias("best_ask")),
        )).alias("price_changes"),
        F.when(kind == "market_resolved", F.col("outcome")).alias("winning_outcome"),
        F.lit("0.01").alias("old_tick_size"), F.lit("0.001").alias("new_tick_size"),
    )
    return t.trades.select(F.to_json(doc).alias("value"))


@query("s2_message_routing", f"""WITH m AS (SELECT *, {MS_SQL} * 1000 AS t FROM trades)
 SELECT 'book' AS kind, asset_id, t AS ts_us, round((price + price + 0.04) / 2, 6) AS v FROM m WHERE event_type = 'view'
 UNION ALL SELECT 'price_change', asset_id, t, round((price + price + 0.04) / 2, 6) FROM m WHERE event_type = 'click'
 UNION ALL SELECT 'price_change', asset_id || '#', t, round(price, 6) FROM m WHERE event_type = 'click'
 UNION ALL SELECT 'trade', asset_id, t, size FROM m WHERE event_type = 'purchase' AND size <> 0
 UNION ALL SELECT 'tick_size', asset_id, t, 0.001::double FROM m WHERE event_type = 'signup'
 UNION ALL SELECT 'resolved', asset_id, t, CASE WHEN outcome = 'YES' THEN 1.0::double ELSE 0.0::double END FROM m WHERE event_type = 'error'""")
def _(t):
    v = F.when(F.col("kind").isin("book", "price_change"), F.round("v", 6)).otherwise(F.col("v"))
    return R.routed(R.messages(raw_messages(t))).withColumn("v", v)


@query("s3_market_tokens", """SELECT market_id, cast(i AS int) AS outcome_index, 't' || market_no || CASE i WHEN 0 THEN 'y' ELSE 'n' END AS token_id
 FROM markets, (VALUES (0), (1)) v(i) WHERE token_ids IS NOT NULL""")
def _(t):
    return R.market_tokens(t.markets)


@query("s4_lead_feed", f"""SELECT 'trade' AS kind, coin, {MS_SQL} * 1000 AS ts_us, round(price * size, 6) AS v FROM lead_trades WHERE price > 0 AND size > 0
 UNION ALL SELECT 'book', coin, {MS_SQL} * 1000, round((price + (price + 0.02)) / 2, 6) FROM lead_trades""")
def _(t):
    base = t.lead_trades
    trade = F.struct(F.lit("trade").alias("kind"), "coin", F.expr(MS).cast("double").alias("epochMs"), F.col("price").alias("p"), F.col("side").alias("s"), F.col("size").alias("sz"))
    lvl = lambda x: F.array(F.struct(x.cast("string").alias("px"), F.lit("1").alias("sz")))
    book = F.struct(F.lit("book").alias("kind"), "coin", F.expr(MS).cast("double").alias("epochMs"), lvl(F.col("price")).alias("bids"), lvl(F.col("price") + 0.02).alias("asks"))
    raw = base.select(F.explode(F.array(F.to_json(trade), F.to_json(book))).alias("value"))
    a = R.lead_trades(raw).select(F.lit("trade").alias("kind"), "coin", "ts_us", F.round("notional", 6).alias("v"))
    b = R.lead_mids(raw).select(F.lit("book").alias("kind"), "coin", "ts_us", F.round("mid", 6).alias("v"))
    return a.unionByName(b)


def raw_transfers(t):
    other = F.lit("0x" + "f" * 40)
    doc = F.struct(
        "wallet",
        F.when(F.col("side") == "BUY", other).otherwise(F.col("wallet")).alias("from_address"),
        F.when(F.col("side") == "BUY", F.col("wallet")).otherwise(other).alias("to_address"),
        F.round(F.col("size") * 1000000).cast("long").cast("string").alias("value"),
        F.lit(6).alias("token_decimals"), F.col("market_id").alias("token_symbol"), F.expr(MS).cast("string").alias("block_timestamp"),
    )
    return t.trades.select(F.to_json(doc).alias("value"))


@query("s5_token_transfers", f"""WITH r AS (SELECT wallet, {MS_SQL} * 1000 AS ts_us, side, size, market_id FROM trades)
 SELECT wallet, ts_us, side, round(size, 4) AS size, market_id FROM r""")
def _(t):
    return R.transfer_history(raw_transfers(t)).withColumn("size", F.round("size", 4))


@query("s6_event_envelopes", """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'L1' ELSE 'L3' END AS layer, event_type, ts_us AS received_us FROM trades""")
def _(t):
    env = t.trades.select(
        "event_id", F.when(F.col("event_type").isin("view", "click"), "L1").otherwise("L3").alias("layer"), "event_type",
        F.col("ts_us").alias("received_us"),
    )
    replay = env.filter("event_type = 'click'").withColumn("received_us", F.col("received_us") + 1)
    return R.once_per_event(env.unionByName(replay).unionByName(replay))


@query("s7_cluster_map", """SELECT market_id, 'c' || (market_no % 40) AS cluster_id, cast(CASE WHEN market_no % 3 = 0 THEN -1 ELSE 1 END AS int) AS internal_direction
 FROM markets WHERE market_no % 10 <> 9""")
def _(t):
    m = t.markets
    cid = F.when(F.col("market_no") % 10 == 9, "").otherwise(F.concat(F.lit("c"), (F.col("market_no") % 40).cast("string")))
    doc = F.to_json(F.create_map("market_id", F.struct(cid.alias("cluster_id"), F.when(F.col("market_no") % 3 == 0, -1).otherwise(1).alias("internal_direction"))))
    return R.cluster_map(m.select(doc.alias("value")))


@query("s7_lead_market_map", """SELECT DISTINCT 'BTC' || (market_no % 30) AS coin, market_id FROM markets""")
def _(t):
    doc = F.to_json(F.create_map(F.concat(F.lit("BTC"), (F.col("market_no") % 30).cast("string")), F.array("market_id")))
    return R.lead_market_map(t.markets.select(doc.alias("value"))).distinct()


@query("s7_address_list", """SELECT DISTINCT wallet AS address FROM entities""")
def _(t):
    lines = F.concat(F.lit("  "), F.upper(F.substring("wallet", 3, 40)), F.lit("  # listed"))
    raw = t.entities.select(F.concat(F.lit("0x"), F.trim(lines)).alias("value"))
    return R.address_list(raw)


@query("s8_attribution_records", """SELECT closed_us AS ts_us, reason, est AS expected_ev, pnl AS realized_pnl, entry_price AS posterior_probability, 0.25::double AS alpha FROM settlements""")
def _(t):
    doc = F.struct(
        F.col("closed_us").alias("ts_us"), "reason", F.col("est").alias("expected_ev"), F.col("pnl").alias("realized_pnl"),
        F.col("entry_price").alias("posterior_probability"), F.lit(0.25).alias("alpha"),
    )
    # Appended in two writes, as closed days would be, then read back.
    folder = f"{checkpoint_folder(t.settlements)}/attribution-{uuid.uuid4().hex}"
    for part in ("trade_id % 2 = 0", "trade_id % 2 = 1"):
        K.append_json(t.settlements.filter(part).select(doc.alias("d")).select("d.*"), folder)
    return R.attribution_records(t.spark.read.text(folder))


@query("s9_log_metrics", f"""WITH l AS (SELECT *, 't' || (event_id % 5 + 1) AS tr, ts_us // 1000000 * 1000000 AS s FROM trades)
 SELECT CASE WHEN tr = 't4' THEN 't3' ELSE tr END AS tier, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS trade_ticks,
 count(*) FILTER (WHERE event_type = 'signup') AS entropy_fires, count(*) FILTER (WHERE event_type = 'view') AS queue_puts
 FROM l WHERE s >= {AS_OF_US - 20 * DAY_US} AND event_type <> 'error' GROUP BY 1""")
def _(t):
    ev = F.col("event_type")
    tag = (
        F.when(ev == "click", "[DIAG][TRADE_TICK] asset=x").when(ev == "purchase", "got last_trade_price")
        .when(ev == "signup", "[DIAG][ENTROPY_FIRE] z=-5").when(ev == "view", "signal_queue put")
    )
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss")
    line = F.when(ev == "error", "Traceback without stamp").otherwise(
        F.concat(stamp, F.lit(" INFO "), tag, F.lit(" tier=t"), (F.col("event_id") % 5 + 1).cast("string"))
    )
    return R.log_metrics(t.trades.select(line.alias("value")), AS_OF_US - 20 * DAY_US)


def raw_samples(t):
    s = lambda ok, ask, bid, tps: F.struct(ok.alias("book_ok"), ask.alias("best_ask_raw"), bid.alias("best_bid_raw"), tps.alias("trades_per_sec"))
    price = F.col("price")
    doc = F.struct(
        F.col("market_id").alias("slug"),
        F.array(
            s(F.col("event_id") % 4 != 0, price, price - F.col("size") / 100, F.col("size") / 10),
            s(F.lit(True), price + 0.01, price - 0.01, F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("size") / 20)),
        ).alias("samples"),
    )
    return t.trades.select(F.to_json(doc).alias("value"))


@query("s10_window_samples", """SELECT market_id AS slug, event_id % 4 <> 0 AS book_ok, round(price, 6) AS best_ask_raw, round(size / 10, 6) AS trades_per_sec FROM trades
 UNION ALL SELECT market_id, true, round(price + 0.01, 6), round(CASE WHEN event_id % 3 = 0 THEN NULL ELSE size / 20 END, 6) FROM trades""")
def _(t):
    s = R.window_samples(raw_samples(t))
    return s.select("slug", "book_ok", F.round("best_ask_raw", 6).alias("best_ask_raw"), F.round("trades_per_sec", 6).alias("trades_per_sec"))


@query("s11_keyed_upsert", """WITH n AS (SELECT wallet, max(ts_us) AS updated_us, max(round(price, 4)) AS insider_score,
   arg_max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE side END, ts_us) FILTER (WHERE event_id % 3 <> 0) AS primary_tag,
   arg_max(market_id, ts_us) AS entity_id, count(*) AS c FROM trades GROUP BY wallet)
 SELECT coalesce(e.wallet, n.wallet) AS wallet, coalesce(n.updated_us, e.updated_us) AS updated_us, coalesce(n.entity_id, e.entity_id) AS entity_id,
   coalesce(n.primary_tag, e.primary_tag) AS primary_tag, greatest(e.insider_score, n.insider_score) AS insider_score,
   coalesce(e.sample_size, 0) + coalesce(n.c, 0) AS sample_size FROM entities e FULL JOIN n ON e.wallet = n.wallet""")
def _(t):
    new = t.trades.select(
        "wallet", F.col("ts_us").alias("updated_us"), F.col("market_id").alias("entity_id"),
        F.when(F.col("event_id") % 3 != 0, F.col("side")).alias("primary_tag"), F.round("price", 4).alias("insider_score"),
        F.lit(0).cast("long").alias("sample_size"),
    )
    policies = {"entity_id": K.OVERWRITE, "primary_tag": K.KEEP_OLD, "insider_score": K.MAXIMUM, "sample_size": K.COUNTER}
    return K.upsert(t.entities, new, ["wallet"], policies, "updated_us")


@query("s13_retention", """SELECT tier, execution_id, created_us FROM executions
 QUALIFY row_number() OVER (PARTITION BY tier ORDER BY created_us DESC, execution_id) <= 1440""")
def _(t):
    e = t.executions.select("tier", "execution_id", "created_us")
    return K.keep_newest(e, ["tier"], [F.desc("created_us"), F.asc("execution_id")], 1440)


@query("s14_insert_or_ignore", f"""WITH st AS (SELECT * FROM trades WHERE ts_us < {AS_OF_US - 10 * DAY_US} AND event_id % 2 = 0), c AS (SELECT asset_id, max(ts_us) AS cur FROM st GROUP BY 1)
 SELECT event_id, t.asset_id, tx_hash FROM trades t LEFT JOIN c ON t.asset_id = c.asset_id WHERE ts_us > coalesce(cur, 0) AND tx_hash NOT IN (SELECT tx_hash FROM st)""")
def _(t):
    stored = t.trades.filter((F.col("ts_us") < AS_OF_US - 10 * DAY_US) & (F.col("event_id") % 2 == 0))
    return K.unseen(t.trades, stored, "tx_hash", "asset_id").select("event_id", "asset_id", "tx_hash")


@query("s15_observation_fanout", """WITH a AS (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [wallet] WHEN event_id % 3 = 1 THEN ['0x' || lpad(cast(event_id % 50 AS varchar), 40, '0'), wallet]
   ELSE [wallet] END) AS address FROM trades) SELECT DISTINCT event_id, address FROM a""")
def _(t):
    raw = t.trades.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("0x"), F.lpad((F.col("event_id") % 50).cast("string"), 40, "0"))).alias("maker"),
        F.concat(F.lit("0x"), F.upper(F.substring("wallet", 3, 40))).alias("taker"), F.col("wallet").alias("owner"),
    )
    return R.trade_addresses(raw, ["maker", "taker", "owner"]).select("event_id", "address")


@query("s16_purge", """SELECT count(*) AS "before", count(*) FILTER (WHERE size > 0) AS "after", count(*) FILTER (WHERE size <= 0) AS purged FROM trades""")
def _(t):
    return K.purge(t.trades, F.col("size") <= 0)[2]


@query("s16_constant_columns", """SELECT 'status' AS column_name, count(DISTINCT status) <= 1 AS is_constant FROM trades
 UNION ALL SELECT 'price', count(DISTINCT price) <= 1 FROM trades UNION ALL SELECT 'source', true""")
def _(t):
    return K.constant_columns(t.trades.withColumn("source", F.lit("feed")), ["status", "price", "source"])


@query("p1_timestamps", f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts_us // 1000000 * 1000000 WHEN 1 THEN ts_us // 1000 * 1000 WHEN 2 THEN ts_us // 1000000 * 1000000
   WHEN 3 THEN ts_us // 1000000 * 1000000 ELSE NULL END AS utc_us, event_id % 5 = 4 AS rejected FROM trades""")
def _(t):
    iso = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss")
    which = F.col("event_id") % 5
    raw = (
        F.when(which == 0, F.expr("cast(ts_us div 1000000 as string)")).when(which == 1, F.concat(F.lit(" "), F.expr(MS).cast("string")))
        .when(which == 2, F.concat(iso, F.lit("Z"))).when(which == 3, F.concat(iso, F.lit("+00:00"))).otherwise("soon")
    )
    out = t.trades.select("event_id", P.normalise_time(raw).alias("utc_us"))
    return out.withColumn("rejected", F.col("utc_us").isNull())
