"""Registered report, window, top-k and set queries."""

import uuid

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators.lineage import checkpoint_folder
from tapewatch.operators import joins as J
from tapewatch.operators import reports as R
from tapewatch.operators.sequence import DAY, HOUR
from tapewatch.registry.join_queries import LEGS_SQL, arbs
from tapewatch.registry.micro import FILLS, IMPACT_SQL, ZSCORE_SQL, fills, impact, zscores
from tapewatch.registry.source_queries import raw_samples
from tapewatch.registry.wallet_queries import observed_bets
from tapewatch.sources import readers as RD
from tapewatch.sources import sinks as K
from tapewatch.sources.bindings import AS_OF_US, ORDERS_AS_OF_US

SINCE = ORDERS_AS_OF_US - 400 * DAY


def r(name, digits, source=None):
    return F.round(source or name, digits).alias(name)


@query("a1_tier_coverage", f"""SELECT tier, count(*) AS total_signals, count(*) FILTER (WHERE accepted = 1) AS accepted, count(*) FILTER (WHERE accepted = 0) AS rejected, round(avg(ev_net) FILTER (WHERE accepted = 1), 6) + 0.0 AS avg_ev,
 round(avg(posterior), 6) AS avg_posterior, count(DISTINCT market_id) AS distinct_markets, round(count(*) FILTER (WHERE accepted = 1) / count(*), 3) AS pass_rate FROM executions WHERE created_us > {SINCE} GROUP BY 1""")
def _(t):
    return R.tier_coverage(t.since("executions", SINCE), SINCE).withColumn("avg_ev", F.round("avg_ev", 6)).withColumn("avg_posterior", F.round("avg_posterior", 6))


@query("a2_active_markets", f"""SELECT tier, market_id, count(*) AS total_signals, count(*) FILTER (WHERE accepted = 1) AS accepted, max(created_us) AS last_us, round(avg(ev_net) FILTER (WHERE accepted = 1), 6) + 0.0 AS avg_ev FROM executions
 WHERE created_us > {SINCE} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY tier ORDER BY max(created_us) DESC, market_id) <= 100""")
def _(t):
    return R.active_markets(t.since("executions", SINCE), SINCE).withColumn("avg_ev", F.round("avg_ev", 6))


def coverage_rows(t, since_us):
    return t.since("trades", since_us).join(t.markets.select("market_id", "tier"), "market_id").select(
        "tier", "market_id", "ts_us", F.col("price").alias("loss_rate"), (F.col("size") / 1000).alias("wallet_coverage"), (F.col("size") > 40).alias("page_saturated"),
        F.round("size").cast("long").alias("ws_ticks"), F.round("usd").cast("long").alias("api_received"),
    )


COV = "count(DISTINCT t.market_id) AS distinct_markets, count(*) AS total_polls, round(avg(price), 6) AS avg_loss, max(price) AS max_loss, round(avg(size / 1000), 6) AS avg_wallet_coverage, count(*) FILTER (WHERE size > 40) AS saturated_polls, cast(sum(cast(round(size) AS bigint)) AS bigint) AS total_ws, cast(sum(cast(round(usd) AS bigint)) AS bigint) AS total_api"


@query("a3_coverage_by_tier", f"SELECT tier, {COV} FROM trades t JOIN markets USING (market_id) WHERE ts_us > {AS_OF_US - 20 * DAY} GROUP BY 1")
def _(t):
    c = R.coverage_summary(coverage_rows(t, AS_OF_US - 20 * DAY), AS_OF_US - 20 * DAY)
    return c.withColumn("avg_loss", F.round("avg_loss", 6)).withColumn("avg_wallet_coverage", F.round("avg_wallet_coverage", 6))


@query("a3_coverage_total", f"SELECT {COV} FROM trades t JOIN markets USING (market_id) WHERE ts_us > {AS_OF_US - 20 * DAY}")
def _(t):
    c = R.coverage_summary(coverage_rows(t, AS_OF_US - 20 * DAY), AS_OF_US - 20 * DAY, by_tier=False)
    return c.withColumn("avg_loss", F.round("avg_loss", 6)).withColumn("avg_wallet_coverage", F.round("avg_wallet_coverage", 6))


def samples(t):
    return impact(t).select("asset_id", "market_id", "ts_us", "delta_price", F.col("size").alias("trade_size"), "lambda_obs")


SAMPLES_SQL = f"{IMPACT_SQL}, samples AS (SELECT asset_id, market_id, ts_us, delta_price, size AS trade_size, lambda_obs FROM impact)"


@query("s12_impact_samples", f"WITH {SAMPLES_SQL} SELECT asset_id, ts_us, trade_size, round(lambda_obs, 6) AS lambda_obs FROM samples WHERE trade_size > 0 AND lambda_obs > 0")
def _(t):
    # The guarded append, then what later readers see.
    good = K.accepted_samples(samples(t)).withColumn("day", F.floor(F.col("ts_us") / DAY))
    folder = f"{checkpoint_folder(good)}/impact-{uuid.uuid4().hex}"
    K.append_parquet(good, folder, ["day"])
    return t.spark.read.parquet(folder).select("asset_id", "ts_us", "trade_size", r("lambda_obs", 6))


@query("a6_impact_p75", """WITH s AS (SELECT asset_id, size / (price * 10) AS l FROM trades WHERE event_type <> 'error'), k AS (SELECT asset_id, l, row_number() OVER (PARTITION BY asset_id ORDER BY l) - 1 AS i, count(*) OVER (PARTITION BY asset_id) AS n FROM s),
 g AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS i, count(*) OVER () AS n FROM s)
 SELECT asset_id, n, CASE WHEN n >= 60 THEN round(l, 6) END AS own_p75, round(CASE WHEN n >= 60 THEN l ELSE (SELECT l FROM g WHERE i = floor(n * 0.75)) END, 6) AS p75 FROM k WHERE i = floor(n * 0.75)""")
def _(t):
    s = t.trades.filter("event_type <> 'error'").select("asset_id", (F.col("size") / (F.col("price") * 10)).alias("lambda_obs"))
    return R.impact_p75(s, min_samples=60).select("asset_id", "n", r("own_p75", 6), r("p75", 6))


@query("a7_hourly_impact", f"""WITH {SAMPLES_SQL} SELECT ts_us // {HOUR} * {HOUR} AS hour_us, count(*) AS samples, round(avg(lambda_obs), 6) AS avg_lambda, min(ts_us) AS first_us, max(ts_us) AS last_us FROM samples WHERE ts_us > {AS_OF_US - 10 * DAY} GROUP BY 1""")
def _(t):
    return R.hourly_impact(samples(t), AS_OF_US - 10 * DAY).withColumn("avg_lambda", F.round("avg_lambda", 6))


@query("a8_paper_by_tier", f"SELECT tier, count(*) AS trades, round(avg(ev_net), 6) + 0.0 AS avg_ev, min(created_us) AS first_us, max(created_us) AS last_us FROM executions WHERE mode = 'PAPER' AND created_us > {SINCE} GROUP BY 1")
def _(t):
    return R.paper_by_tier(t.executions, SINCE).withColumn("avg_ev", F.round("avg_ev", 6))


@query("a9_asset_activity", f"WITH {SAMPLES_SQL} SELECT asset_id, count(*) AS samples, round(avg(lambda_obs), 6) AS avg_lambda, count(DISTINCT ts_us // {HOUR}) AS active_hours, min(ts_us) AS first_us, max(ts_us) AS last_us FROM samples GROUP BY 1 ORDER BY samples DESC, asset_id LIMIT 10")
def _(t):
    return R.asset_activity(samples(t)).withColumn("avg_lambda", F.round("avg_lambda", 6))


@query("a10_top_wallets", f"""WITH {FILLS}, w AS (SELECT wallet, round(sum(usd), 4) AS usd_volume, count(*) AS trade_count FROM fills GROUP BY 1 ORDER BY usd_volume DESC, wallet LIMIT 50)
 SELECT w.*, entity_id, insider_score FROM w LEFT JOIN entities USING (wallet)""")
def _(t):
    top = R.top_wallets(fills(t), 50).withColumn("usd_volume", F.round("usd_volume", 4))
    return top.join(t.entities.select("wallet", "entity_id", "insider_score"), "wallet", "left")


def linked(t):
    return R.with_payload(J.with_link(t.observations.filter("obs_type = 'clob_trade'"), t.link_map, "t2"))


LINKED_SQL = """lk AS (SELECT *, amount * price AS usd FROM (SELECT o.obs_id, o.address, l.token_id, json_extract_string(payload_json, '$.side') AS side, json_extract_string(payload_json, '$.outcome') AS outcome,
 cast(json_extract_string(payload_json, '$.price') AS double) AS price, cast(coalesce(json_extract_string(payload_json, '$.size'), json_extract_string(payload_json, '$.amount')) AS double) AS amount
 FROM observations o JOIN link_map l ON lower(l.token_id) = lower(o.asset_id) WHERE l.market_tier = 't2' AND obs_type = 'clob_trade'))"""
PB = "CASE WHEN {p} < 0.20 THEN '< 0.20' WHEN {p} BETWEEN 0.20 AND 0.40 THEN '0.20-0.40' WHEN {p} BETWEEN 0.40 AND 0.60 THEN '0.40-0.60' WHEN {p} BETWEEN 0.60 AND 0.80 THEN '0.60-0.80' ELSE '>= 0.80' END"
UB = "CASE WHEN usd < 10 THEN '< $10' WHEN usd BETWEEN 10 AND 50 THEN '$10-$50' WHEN usd BETWEEN 50 AND 100 THEN '$50-$100' WHEN usd BETWEEN 100 AND 500 THEN '$100-$500' ELSE '>= $500' END"


@query("a10_histograms", f"""WITH {LINKED_SQL} SELECT 'side' AS kind, side AS bucket, count(*) AS n FROM lk GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM lk GROUP BY 2
 UNION ALL SELECT 'price', {PB.format(p='(price / 100)')}, count(*) FROM lk GROUP BY 2 UNION ALL SELECT 'usd', {UB}, count(*) FROM lk GROUP BY 2""")
def _(t):
    rows = linked(t)
    kinds = {"side": F.col("side"), "outcome": F.col("outcome"), "price": R.price_bucket(F.col("price") / 100), "usd": R.usd_bucket(F.col("usd"))}
    # One pass: each row yields its four (kind, bucket) labels, counted together.
    labels = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("bucket")) for k, v in kinds.items()])
    return rows.select(F.explode(labels).alias("l")).groupBy("l.kind", "l.bucket").agg(F.count(F.lit(1)).alias("n"))


@query("a10_token_breakdown", f"WITH {LINKED_SQL} SELECT token_id, count(*) AS observations, count(DISTINCT address) AS wallets, round(sum(usd), 4) AS total_usd FROM lk GROUP BY 1 ORDER BY observations DESC, token_id LIMIT 20")
def _(t):
    return R.token_breakdown(linked(t)).withColumn("total_usd", F.round("total_usd", 4))


@query("a10_trade_summary", f"""WITH {LINKED_SQL} SELECT count(*) AS observations, count(DISTINCT address) AS wallets, round(sum(usd), 4) AS total_usd, round(avg(usd), 4) AS avg_usd, min(usd) AS min_usd, max(usd) AS max_usd, round(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price FROM lk""")
def _(t):
    s = R.trade_summary(linked(t))
    return s.withColumn("total_usd", F.round("total_usd", 4)).withColumn("avg_usd", F.round("avg_usd", 4)).withColumn("avg_price", F.round("avg_price", 6))


@query("a10_injected_wallets", """WITH w AS (SELECT address, max(CASE WHEN obs_type = 'whale_scan' THEN 1 ELSE 0 END) AS i FROM observations GROUP BY 1) SELECT count(*) AS wallets, cast(sum(i) AS bigint) AS injected, round(sum(i) / count(*), 6) AS injected_share FROM w""")
def _(t):
    return R.injected_wallets(t.observations, F.col("obs_type") == "whale_scan").withColumn("injected_share", F.round("injected_share", 6))


@query("a10_gate_reasons", f"SELECT gate_reason, count(*) AS n FROM executions WHERE created_us > {SINCE} GROUP BY 1 ORDER BY n DESC LIMIT 10")
def _(t):
    h = R.histogram(t.executions.filter(F.col("created_us") > SINCE), F.col("gate_reason"), "gate_reason")
    return R.newest(h, [F.desc("n"), F.asc("gate_reason")], 10)


@query("a10_score_buckets", """SELECT CASE WHEN insider_score >= 0.80 THEN '0.80+ (high confidence)' WHEN insider_score >= 0.65 THEN '0.65-0.80 (elevated)' WHEN insider_score >= 0.55 THEN '0.55-0.65 (threshold)' WHEN insider_score >= 0.40 THEN '0.40-0.55 (moderate)' ELSE '< 0.40 (low)' END AS bucket, count(*) AS n FROM entities WHERE insider_score > 0 GROUP BY 1""")
def _(t):
    return R.histogram(t.entities.filter("insider_score > 0"), R.score_bucket(F.col("insider_score")))


@query("a35_outcome_rate", """SELECT count(*) AS hits, round(count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type IN ('click', 'view')), 6) AS win_rate, round(min(-size), 4) AS min_z, round(max(-size), 4) + 0.0 AS max_z, round(avg(-size), 4) AS avg_z FROM trades""")
def _(t):
    hits = t.trades.select(F.when(F.col("event_type") == "click", "win").when(F.col("event_type") == "view", "loss").alias("outcome"), (-F.col("size")).alias("z"))
    return R.outcome_rate(hits).select("hits", r("win_rate", 6), r("min_z", 4), r("max_z", 4), r("avg_z", 4))


@query("a36_insight_counts", "SELECT 'trades' AS table_name, count(*) AS row_count FROM trades UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'settlements', count(*) FROM settlements")
def _(t):
    return R.insight_counts({"trades": t.trades, "entities": t.entities, "settlements": t.settlements})


@query("a36_source_shares", "SELECT primary_tag, count(*) AS wallets, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM entities GROUP BY 1")
def _(t):
    return R.source_shares(t.entities, "primary_tag")


HEALTH_SQL = f"""tall AS (SELECT ts_us // {6 * HOUR} * {6 * HOUR} AS window_us, CASE event_type WHEN 'click' THEN 'trade_ticks' WHEN 'purchase' THEN 'entropy_fires' WHEN 'signup' THEN 'observations' WHEN 'view' THEN 'impact_samples' ELSE 'updates' END AS k FROM trades
  UNION ALL SELECT ts_us // {6 * HOUR} * {6 * HOUR}, CASE WHEN size > 40 THEN 'live_trades' ELSE 'paper_trades' END FROM trades WHERE size > 12),
 hs AS (SELECT window_us, {', '.join(f"count(*) FILTER (WHERE k = '{k}') AS {k}" for k in ('trade_ticks', 'entropy_fires', 'impact_samples', 'updates', 'paper_trades', 'live_trades', 'observations'))} FROM tall GROUP BY 1),
 snap AS (SELECT *, round(trade_ticks / 360, 2) AS tick_rate, round(paper_trades / greatest(updates, 1), 4) AS pass_rate, round((SELECT count(*) FROM trades WHERE event_type = 'view') / 500, 4) AS accumulation,
   (entropy_fires > 0 AND paper_trades = 0) OR live_trades > 0 AS stale FROM hs)"""


def snapshots(t):
    of = lambda kind: (t.trades.filter(F.col("event_type") == kind), "ts_us")
    parts = {
        "trade_ticks": of("click"), "entropy_fires": of("purchase"), "impact_samples": of("view"), "updates": of("error"),
        "paper_trades": (t.trades.filter("size > 12 and size <= 40"), "ts_us"), "live_trades": (t.trades.filter("size > 40"), "ts_us"), "observations": of("signup"),
    }
    return R.health_snapshots(parts, 6 * HOUR)


@query("a37_health_snapshots", f"WITH {HEALTH_SQL} SELECT * FROM snap")
def _(t):
    return snapshots(t)


@query("a37_health_alerts", f"""WITH {HEALTH_SQL} SELECT window_us, 'CRITICAL' AS severity, 'L4' AS layer, 'live_trades' AS code, live_trades::double AS value FROM snap WHERE live_trades > 0
 UNION ALL SELECT window_us, 'WARN', 'L5', 'no_observations', observations::double FROM snap WHERE observations < 5 UNION ALL SELECT window_us, 'INFO', 'L1', 'rates', tick_rate FROM snap
 UNION ALL SELECT window_us, 'WARN', 'L3/L4', 'gate_blocking', 0.0 FROM snap WHERE stale AND entropy_fires > 0 UNION ALL SELECT window_us, 'WARN', 'L1', 'impact_stalled', accumulation FROM snap WHERE accumulation < 0.1""")
def _(t):
    return R.health_alerts(snapshots(t), "production")


NOW = AS_OF_US - DAY


@query("a38_metric_snapshot", f"""WITH s AS (SELECT asset_id, ts_us, size / (price * 10) AS l FROM trades WHERE ts_us > {NOW - 5 * DAY} AND ts_us <= {NOW}), k AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS i, count(*) OVER () AS n FROM s),
 x AS (SELECT count(*) AS paper_trades, count(*) FILTER (WHERE pnl > 0) AS paper_wins FROM settlements), g AS (SELECT * FROM executions WHERE created_us > {NOW - 4000 * DAY} AND created_us <= {NOW})
 SELECT (SELECT count(*) FROM trades WHERE ts_us > {NOW - DAY} AND ts_us <= {NOW}) AS trade_ticks, (SELECT count(*) FROM quotes WHERE ts_us > {NOW - DAY} AND ts_us <= {NOW}) AS book_events,
  (SELECT count(*) FROM s) AS impact_samples, (SELECT count(DISTINCT asset_id) FROM s) AS impact_assets, (SELECT round(l, 6) FROM k WHERE i = floor(n * 0.75)) AS impact_p75, paper_trades, paper_wins, round(paper_wins / paper_trades, 6) AS win_rate,
  NOT ((SELECT count(*) FROM s) >= 500 AND paper_trades >= 100 AND paper_wins / paper_trades >= 0.55) AS locked, (SELECT round(avg(price), 6) FROM trades WHERE event_type = 'purchase' AND ts_us > {NOW - 5 * DAY} AND ts_us <= {NOW}) AS mean_z FROM x""")
def _(t):
    s = t.trades.select("asset_id", "ts_us", (F.col("size") / (F.col("price") * 10)).alias("lambda_obs"))
    z = t.trades.filter("event_type = 'purchase'").select("ts_us", F.col("price").alias("z"))
    m = R.metric_snapshot(t.trades, t.quotes, t.executions, z, s, t.settlements, NOW, DAY, 5 * DAY)
    return m.select("trade_ticks", "book_events", "impact_samples", "impact_assets", r("impact_p75", 6), "paper_trades", "paper_wins", r("win_rate", 6), "locked", r("mean_z", 6))


@query("a38_rate_counts", f"""WITH w AS (SELECT ts_us // {HOUR} * {HOUR} - k * {HOUR} AS window_us FROM trades, (VALUES (0), (1), (2), (3), (4), (5)) v(k)) SELECT window_us, count(*) AS events FROM w GROUP BY 1""")
def _(t):
    return R.rate_counts(t.trades, 6 * HOUR, HOUR)


@query("a39_daily_counts", f"""SELECT 'catalysts' AS kind, ts_us // {DAY} * {DAY} AS day_us, count(*) AS n FROM trades WHERE event_type = 'view' GROUP BY 2 UNION ALL SELECT 'violations', ts_us // {DAY} * {DAY}, count(*) FROM trades WHERE event_type = 'error' GROUP BY 2
 UNION ALL SELECT 'accepted', created_us // {DAY} * {DAY}, count(*) FROM executions WHERE accepted = 1 GROUP BY 2""")
def _(t):
    return R.daily_counts({
        "catalysts": (t.trades.filter("event_type = 'view'"), "ts_us"), "violations": (t.trades.filter("event_type = 'error'"), "ts_us"),
        "accepted": (t.executions.filter("accepted = 1"), "created_us"),
    })


@query("a39_link_stats", """SELECT (SELECT count(*) FROM link_map) AS mappings, (SELECT count(*) FROM link_map WHERE event_slug IS NULL AND source <> 'api') AS open, (SELECT count(*) FROM link_map WHERE event_slug IS NULL AND source = 'api') AS closed,
 (SELECT round(sum(size), 4) FROM holdings WHERE side = 'YES') AS reserved_usd""")
def _(t):
    un = t.link_map.filter("event_slug is null").select((F.col("source") == "api").alias("resolved"))
    res = t.holdings.select(F.when(F.col("side") == "YES", "RESERVED").otherwise("RELEASED").alias("status"), F.col("size").alias("amount"))
    return R.link_stats(t.link_map, un, res).withColumn("reserved_usd", F.round("reserved_usd", 4))


@query("a40_book_depth", """WITH RECURSIVE b AS (SELECT event_id, bid, ask, bid_size, ask_size, event_id % 14 AS k FROM quotes), l AS (SELECT b.*, i FROM b, range(14) v(i) WHERE i <= k)
 SELECT event_id, round(sum(CASE WHEN i < 10 THEN (bid - i * 0.001) * bid_size ELSE 0 END), 8) + 0.0 AS bid_depth, round(sum(CASE WHEN i < 10 THEN (ask + i * 0.001) * ask_size ELSE 0 END), 8) + 0.0 AS ask_depth, round(any_value(ask - bid), 6) AS spread FROM l GROUP BY 1""")
def _(t):
    idx = F.sequence(F.lit(0), (F.col("event_id") % 14).cast("int"))
    lv = lambda p, s, d: F.transform(idx, lambda i: F.struct((F.col(p) + i * d).alias("price"), F.col(s).alias("size")))
    b = t.quotes.select("event_id", lv("bid", "bid_size", -0.001).alias("bids"), lv("ask", "ask_size", 0.001).alias("asks"))
    return R.book_depth(b).select("event_id", r("bid_depth", 8), r("ask_depth", 8), r("spread", 6))


@query("a42_sample_quality", """WITH s AS (SELECT market_id AS slug, event_id % 4 <> 0 AS ok, price AS a, price - size / 100 AS b, size / 10 AS q FROM trades UNION ALL SELECT market_id, true, price + 0.01, price - 0.01, CASE WHEN event_id % 3 = 0 THEN NULL ELSE size / 20 END FROM trades),
 g AS (SELECT slug, count(*) AS samples, count(*) FILTER (WHERE ok) AS book_ok, min(a) AS lo, max(a) AS hi, min(b) AS mb, avg(q) FILTER (WHERE q > 0) AS t, max(q) FILTER (WHERE q > 0) AS m FROM s GROUP BY 1)
 SELECT slug, samples, book_ok, round(lo, 6) AS min_ask, round(hi, 6) AS max_ask, round(t, 6) AS avg_tps, round(m, 6) AS max_tps, CASE WHEN t >= 1 THEN 'EXTREME' WHEN t >= 0.1 THEN 'MODERATE' WHEN t IS NOT NULL THEN 'ILLIQUID' ELSE 'NO_TRADES' END AS liquidity,
  CASE WHEN hi - mb > 0.85 THEN 'AMM' WHEN hi - mb IS NOT NULL THEN 'CLOB' END AS verdict FROM g""")
def _(t):
    q = R.sample_quality(RD.window_samples(raw_samples(t)))
    return q.select("slug", "samples", "book_ok", r("min_ask", 6), r("max_ask", 6), r("avg_tps", 6), r("max_tps", 6), "liquidity", "verdict")


@query("a43_opportunity_stats", f"""WITH {LEGS_SQL} SELECT (SELECT count(*) FROM trades) AS total_updates, (SELECT count(DISTINCT asset_id) FROM trades) AS active_tokens, count(*) AS opportunities, count(*) FILTER (WHERE {AS_OF_US - 10 * DAY} - ts_us < {HOUR}) AS opportunities_1h, max(profit_per_100) AS best_profit FROM arbs""")
def _(t):
    return R.opportunity_stats(t.trades, arbs(t), AS_OF_US - 10 * DAY)


@query("a44_first_seen", "SELECT address, min(ts_us) AS first_us FROM observations GROUP BY 1")
def _(t):
    return R.first_seen(t.observations)


@query("a44_recent_wallets", "SELECT address, max(ts_us) AS last_us FROM observations WHERE obs_type = 'clob_trade' AND address <> '0x0000000000000000000000000000000000000000' GROUP BY 1 ORDER BY last_us DESC, address LIMIT 40")
def _(t):
    return R.recent_wallets(t.observations)


@query("a44_system_status", """SELECT CASE WHEN accepted = 1 THEN 'executed' ELSE 'rejected' END AS state, execution_id AS last_execution_id, created_us, CASE WHEN accepted = 0 THEN reason END AS reject_reason FROM executions ORDER BY created_us DESC, execution_id DESC LIMIT 1""")
def _(t):
    return R.system_status(t.executions)


@query("a45_tier1_entities", f"""SELECT count(*) FILTER (WHERE trust_score >= 70 AND primary_tag IN ('BUILDING', 'MACHINERY')) AS tier1_entities FROM entities WHERE updated_us >= {AS_OF_US - 60 * DAY}""")
def _(t):
    return R.tier1_entities(t.entities, ["BUILDING", "MACHINERY"], 70.0, AS_OF_US - 60 * DAY)


@query("a48_tier_distribution", f"SELECT tier, count(*) AS n FROM executions WHERE created_us > {SINCE} GROUP BY 1")
def _(t):
    return R.histogram(t.executions.filter(F.col("created_us") > SINCE), F.col("tier"), "tier")


@query("a49_entropy_diagnostics", f"""WITH {ZSCORE_SQL}, q AS (SELECT market_id, round(z, 6) AS z, n_events % 3 <> 0 AS unlocked FROM zs), k AS (SELECT market_id, z, row_number() OVER (PARTITION BY market_id ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY market_id) AS n FROM q WHERE z IS NOT NULL),
 p AS (SELECT market_id, max(z) FILTER (WHERE i = round_even((n - 1) * 0.5, 0)) AS p50, max(z) FILTER (WHERE i = round_even((n - 1) * 0.9, 0)) AS p90 FROM k GROUP BY 1)
 SELECT market_id, count(*) AS evaluations, count(*) FILTER (WHERE z IS NULL AND NOT unlocked) AS locked, count(*) FILTER (WHERE z IS NULL AND unlocked) AS warming, count(*) FILTER (WHERE z IS NOT NULL) AS ready, count(*) FILTER (WHERE z < -2) AS below,
  round(any_value(p50), 4) + 0.0 AS p50, round(any_value(p90), 4) + 0.0 AS p90 FROM q LEFT JOIN p USING (market_id) GROUP BY 1""")
def _(t):
    z = zscores(t).select("market_id", F.round("z", 6).alias("z"), (F.col("n_events") % 3 != 0).alias("unlocked"))
    d = R.entropy_diagnostics(z, "market_id", -2.0)
    return d.withColumn("p50", F.round("p50", 4)).withColumn("p90", F.round("p90", 4))


@query("a50_execution_reasons", f"SELECT reason, accepted, count(*) AS n, min(created_us) AS first_us, max(created_us) AS last_us FROM executions WHERE created_us > {SINCE} GROUP BY 1, 2")
def _(t):
    return R.execution_reasons(t.executions, SINCE)


@query("w16_latest_rows", "SELECT address AS wallet, market_id, max(ts_us) AS ts_us, arg_max(obs_id, ts_us) AS bet_id FROM observations GROUP BY 1, 2")
def _(t):
    latest = observed_bets(t).groupBy("wallet", "market_id").agg(F.max_by(F.struct("ts_us", "bet_id"), F.struct("ts_us", "bet_id")).alias("l"))
    return latest.select("wallet", "market_id", "l.ts_us", "l.bet_id")


@query("k1_top_settlements", "SELECT trade_id, market_id, pnl FROM settlements WHERE pnl > 0 ORDER BY pnl DESC, trade_id LIMIT 100")
def _(t):
    return R.newest(t.settlements.filter("pnl > 0").select("trade_id", "market_id", "pnl"), [F.desc("pnl"), F.asc("trade_id")], 100)


@query("k2_top_per_market", "SELECT market_id, execution_id, ev_net FROM executions QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY ev_net DESC, execution_id) <= 5")
def _(t):
    from tapewatch.operators.sequence import top_per_key

    return top_per_key(t.executions.select("market_id", "execution_id", "ev_net"), "market_id", [F.desc("ev_net"), F.asc("execution_id")], 5)


@query("k3_priority_fill", """WITH c AS (SELECT asset_id AS token_id, cast(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS int) AS priority, event_id AS position FROM trades),
 b AS (SELECT token_id, min(priority) AS priority, arg_min(position, (priority, position)) AS position FROM c GROUP BY 1) SELECT * FROM b ORDER BY priority, position, token_id LIMIT 200""")
def _(t):
    pr = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return R.priority_fill(t.trades.select(F.col("asset_id").alias("token_id"), pr.alias("priority"), F.col("event_id").alias("position")))


@query("k4_recent_sample", "SELECT address, max(ts_us) AS last_us FROM observations WHERE obs_type = 'clob_trade' AND address <> '0x0000000000000000000000000000000000000000' GROUP BY 1 ORDER BY last_us DESC, address LIMIT 15")
def _(t):
    return R.recent_wallets(t.observations, 15)


@query("u3_stale_ids", "SELECT market_id FROM markets WHERE active EXCEPT SELECT market_id FROM trades")
def _(t):
    return t.markets.filter("active").select("market_id").distinct().join(t.trades.select("market_id"), "market_id", "left_anti")


@query("u4_seed_intersection", "SELECT wallet FROM trades INTERSECT SELECT wallet FROM entities WHERE insider_score >= 0.55")
def _(t):
    return t.trades.select("wallet").distinct().join(t.entities.filter("insider_score >= 0.55").select("wallet"), "wallet", "left_semi")
