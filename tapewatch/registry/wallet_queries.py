"""Registered wallet and performance queries."""

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators import microstructure as M
from tapewatch.operators import performance as PF
from tapewatch.operators import scalars as S
from tapewatch.operators import wallets as A
from tapewatch.operators.sequence import DAY, HOUR
from tapewatch.registry.join_queries import PRICE_SQL, SCORES_SQL, prices, scores
from tapewatch.registry.micro import FILLS, LABEL_SQL, fills, sweeps
from tapewatch.sources.bindings import AS_OF_US, ORDERS_AS_OF_US

FEATURE_SQL = """ft AS (SELECT address, count(*) FILTER (WHERE tr) AS trade_count, coalesce(sum(amt) FILTER (WHERE tr), 0) AS volume, count(DISTINCT market_id) FILTER (WHERE tr) AS unique_markets
  FROM (SELECT *, obs_type = 'clob_trade' AS tr, cast(coalesce(json_extract_string(payload_json, '$.size'), json_extract_string(payload_json, '$.amount')) AS double) AS amt
    FROM observations) GROUP BY 1),
 fb AS (SELECT *, least(1.0, trade_count / 25.0::double) AS burst_score FROM ft),
 risk AS (SELECT *, least(1.0, CASE WHEN trade_count >= 8 THEN 0.28 WHEN trade_count >= 4 THEN 0.12 ELSE 0 END + CASE WHEN volume >= 5000 THEN 0.22 WHEN volume >= 1500 THEN 0.10 ELSE 0 END
   + CASE WHEN unique_markets >= 2 THEN 0.18 ELSE 0 END + 0.22 * burst_score) AS score FROM fb)"""


@query("a11_wallet_risk", f"""WITH {FEATURE_SQL} SELECT address, trade_count, round(volume, 4) AS volume, unique_markets, round(burst_score, 6) AS burst_score, round(score, 6) AS score,
 concat_ws(',', CASE WHEN trade_count >= 8 THEN 'high_trade_count' WHEN trade_count >= 4 THEN 'elevated_trade_count' END, CASE WHEN volume >= 5000 THEN 'large_notional_proxy' WHEN volume >= 1500 THEN 'medium_notional_proxy' END,
  CASE WHEN unique_markets >= 2 THEN 'multi_market_activity' END, CASE WHEN burst_score >= 0.45 THEN 'burst_activity' END) AS reasons, score < 0.06 AND trade_count < 1 AS skipped FROM risk""")
def _(t):
    r = A.insider_risk(A.wallet_features(t.observations))
    return r.select(
        "address", "trade_count", F.round("volume", 4).alias("volume"), "unique_markets", F.round("burst_score", 6).alias("burst_score"),
        F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"), "skipped",
    )


HYGIENE_SQL = """hyg AS (SELECT market_id AS wallet, count(*) AS trades, coalesce(max(pnl) FILTER (WHERE pnl > 0) / sum(pnl) FILTER (WHERE pnl > 0) > 0.5, false) AS win_concentrated,
  count(*) >= 3 AND sum(pnl) > 0 AND abs(max(pnl)) / abs(sum(pnl)) > 0.7 AS one_hit_wonder FROM settlements GROUP BY 1)"""


def hygiene(t):
    return A.trade_hygiene(t.settlements.withColumnRenamed("market_id", "wallet"), max_win_share=0.5)


@query("a15_trade_hygiene", f"WITH {HYGIENE_SQL} SELECT * FROM hyg")
def _(t):
    return hygiene(t)


def labels(t):
    return M.wallet_labels(sweeps(t), min_parents=40, idi_high=0.3, burst_high=0.4, idi_low=0.1, taker_low=0.9)


LABELS_SQL = f"""{LABEL_SQL}, lab AS (SELECT wallet, parents, idi, CASE WHEN parents < 40 THEN 'POTENTIAL_INSIDER' WHEN idi > 0.3 AND coalesce(burst, 0) > 0.4 THEN 'INSIDER_ALGO_SLICING'
  WHEN idi < 0.1 THEN 'MARKET_MAKER_NOISE' ELSE 'UNCERTAIN_NOISE' END AS label FROM idi LEFT JOIN gi USING (wallet))"""
WALLET_PNL_SQL = "wp AS (SELECT '0x' || lpad(cast(o_custkey AS varchar), 40, '0') AS wallet, round(o_totalprice - 250000, 2) AS pnl FROM orders)"


def wallet_pnl(t):
    return t.orders.select(F.concat(F.lit("0x"), F.lpad(F.col("o_custkey").cast("string"), 40, "0")).alias("wallet"), F.round(F.col("o_totalprice") - 250000, 2).alias("pnl"))


@query("a15_scrub_labels", f"""WITH {LABELS_SQL}, {WALLET_PNL_SQL}, h AS (SELECT wallet, coalesce(max(pnl) FILTER (WHERE pnl > 0) / sum(pnl) FILTER (WHERE pnl > 0) > 0.6, false) OR (count(*) >= 3 AND sum(pnl) > 0 AND abs(max(pnl)) / abs(sum(pnl)) > 0.7) AS noise FROM wp GROUP BY 1)
 SELECT wallet, label, CASE WHEN coalesce(noise, false) THEN 'NOISE' WHEN label IN ('INSIDER_ALGO_SLICING', 'POTENTIAL_INSIDER') THEN 'LONG_TERM_INSIDER' ELSE 'WATCHLIST_UNCERTAIN' END AS scrub_label FROM lab LEFT JOIN h USING (wallet)""")
def _(t):
    return A.scrub_labels(A.trade_hygiene(wallet_pnl(t), 0.6), labels(t)).select("wallet", "label", "scrub_label")


DISCOVERY_SQL = f"""cand AS (SELECT wallet, CASE WHEN insider_score > 0.5 THEN 1.0 ELSE 0.0 END AS pnl, CASE WHEN sample_size % 2 = 0 THEN '' ELSE 'LEADERBOARD' END AS discovery_source FROM entities),
 hist AS (SELECT wallet, count(*) AS sample_size, abs(sum(CASE WHEN side = 'BUY' THEN usd ELSE -usd END)) / sum(usd) AS idi, max(usd / (size * 4 + 0.5)) AS share FROM trades WHERE usd > 0 GROUP BY 1),
 filt AS (SELECT c.wallet, coalesce(h.sample_size, 0) AS sample_size, coalesce(idi, 0) AS idi, CASE WHEN h.wallet IS NULL AND (pnl > 0 OR discovery_source <> '') THEN 'no_history_observed_with_source_signal' WHEN h.wallet IS NULL THEN 'no_history_no_signal_assumed_mm'
   WHEN idi < 0.05 THEN 'idi_below_0.3_market_maker_like' WHEN share >= 0.2416 THEN 'single_trade_ge_50pct_balance' ELSE 'passed_idi_and_kelly_filters' END AS scrub_reason FROM cand c LEFT JOIN hist h USING (wallet))"""


def discovery_inputs(t):
    cand = t.entities.select("wallet", F.when(F.col("insider_score") > 0.5, 1.0).otherwise(0.0).alias("pnl"), F.when(F.col("sample_size") % 2 == 0, "").otherwise("LEADERBOARD").alias("discovery_source"))
    hist = t.trades.filter("usd > 0").select("wallet", "side", "usd", (F.col("size") * 4 + 0.5).alias("balance_before"))
    return cand, hist


@query("a15_discovery_filter", f"""WITH {DISCOVERY_SQL} SELECT wallet, sample_size, round(idi, 6) AS idi, scrub_reason,
 CASE WHEN scrub_reason IN ('no_history_no_signal_assumed_mm', 'idi_below_0.3_market_maker_like') THEN 'MARKET_MAKER' WHEN scrub_reason = 'single_trade_ge_50pct_balance' THEN 'DEGEN_GAMBLER' END AS drop_tag FROM filt""")
def _(t):
    d = A.discovery_filter(*discovery_inputs(t), min_idi=0.05, max_stake_share=0.2416)
    return d.select("wallet", "sample_size", F.round("idi", 6).alias("idi"), "scrub_reason", "drop_tag")


def observed_bets(t):
    return t.observations.select(
        F.col("address").alias("wallet"), "market_id", "ts_us", F.col("obs_id").alias("bet_id"), S.payload_amount(F.col("payload_json")).alias("stake")
    )


PATTERN_SQL = f"""ob AS (SELECT obs_id, address AS wallet, market_id, ts_us, cast(coalesce(json_extract_string(payload_json, '$.size'), json_extract_string(payload_json, '$.amount')) AS double) AS stake FROM observations),
 fs AS (SELECT wallet, min(ts_us) AS f FROM ob GROUP BY 1),
 pr AS (SELECT wallet, market_id, max(ts_us) AS ts_us, arg_max(stake, ts_us) AS stake, arg_max(obs_id, ts_us) AS obs_id FROM ob GROUP BY 1, 2),
 q AS (SELECT p.*, ({AS_OF_US} - f) / {float(DAY)} AS age_days, coalesce(pp.settlement_price, 0.5) AS prior,
   (SELECT count(DISTINCT o.market_id) FROM ob o WHERE o.wallet = p.wallet AND o.market_id <> p.market_id AND o.ts_us > {AS_OF_US - 3 * DAY}) AS correlated_mkts,
   (SELECT count(*) FROM ob o JOIN fs USING (wallet) WHERE o.market_id = p.market_id AND o.wallet <> p.wallet AND o.ts_us > p.ts_us - {2 * DAY} AND o.ts_us <= p.ts_us AND o.stake BETWEEN p.stake * (1 - 0.2) AND p.stake * (1 + 0.2) AND p.ts_us - fs.f <= {25 * DAY}) AS cluster_bets,
   (SELECT count(*) FROM ob o WHERE o.market_id = p.market_id AND o.wallet <> p.wallet AND abs(o.ts_us - p.ts_us) <= {6 * HOUR} AND o.stake BETWEEN p.stake * (1 - 0.2) AND p.stake * (1 + 0.2)) AS same_ts_bets,
   (SELECT count(*) > 0 FROM ob o WHERE o.wallet = p.wallet AND o.market_id = p.market_id AND o.stake >= 800) AND (SELECT count(*) > 0 FROM ob o WHERE o.wallet = p.wallet AND o.market_id <> p.market_id AND o.stake > 0 AND o.stake <= 100) AS has_decoy
   FROM pr p JOIN fs USING (wallet) LEFT JOIN prices pp USING (market_id) WHERE p.ts_us > {AS_OF_US - 20 * DAY}),
 sc AS (SELECT *, least(1.0, CASE WHEN age_days < 0.02 THEN 0.40 WHEN age_days < 1 THEN 0.35 WHEN age_days < 7 THEN 0.25 WHEN age_days < 30 THEN 0.10 ELSE 0 END
   + CASE WHEN prior < 0.05 THEN 0.30 WHEN prior < 0.10 THEN 0.22 WHEN prior < 0.20 THEN 0.14 WHEN prior < 0.35 THEN 0.07 ELSE 0 END + CASE WHEN correlated_mkts >= 4 THEN 0.15 WHEN correlated_mkts >= 2 THEN 0.10 ELSE 0 END
   + CASE WHEN cluster_bets >= 10 THEN 0.20 WHEN cluster_bets >= 3 THEN 0.12 WHEN cluster_bets >= 1 THEN 0.05 ELSE 0 END + CASE WHEN has_decoy THEN 0.10 ELSE 0 END)::double AS pattern_score,
   CASE WHEN cluster_bets >= 3 AND has_decoy THEN 'DECOY_CLUSTER' WHEN cluster_bets >= 3 THEN 'CLUSTER' ELSE 'SOLO_OP' END AS case_type FROM q)"""


def pattern_flags(t):
    pri = prices(t).withColumnRenamed("settlement_price", "prior")
    f = A.pattern_factors(observed_bets(t), pri, AS_OF_US, 20 * 24, 3 * DAY, 2 * DAY, 25 * DAY, 800.0, 100.0, 6 * HOUR)
    return A.pattern_scores(f)


@query("a16_pattern_scores", f"""WITH {PRICE_SQL}, {PATTERN_SQL} SELECT wallet, market_id, stake, round(age_days, 6) AS age_days, prior, correlated_mkts, cluster_bets, same_ts_bets, has_decoy, round(pattern_score, 4) AS pattern_score, case_type FROM sc""")
def _(t):
    return pattern_flags(t).select(
        "wallet", "market_id", "stake", F.round("age_days", 6).alias("age_days"), "prior", "correlated_mkts", "cluster_bets", "same_ts_bets", "has_decoy",
        F.round("pattern_score", 4).alias("pattern_score"), "case_type",
    )


@query("j28_pattern_backfill", f"""WITH {PRICE_SQL}, {PATTERN_SQL} SELECT wallet, market_id, ts_us, round(pattern_score, 4) AS pattern_score, case_type FROM sc WHERE round(pattern_score, 4) >= 0.4""")
def _(t):
    return pattern_flags(t).filter(F.round("pattern_score", 4) >= 0.4).select("wallet", "market_id", "ts_us", F.round("pattern_score", 4).alias("pattern_score"), "case_type")


MIN_USD = {"t1": 0.5, "t2": 2.0, "t3": 4.0, "t5": 1.0}
WHALE_SQL = """tt AS (SELECT t.*, m.tier, size * price AS size_usd FROM trades t JOIN markets m USING (market_id)), av AS (SELECT market_id, avg(size_usd) AS market_avg FROM tt GROUP BY 1),
 hh AS (SELECT wallet, count(*) AS hist_n, count(DISTINCT market_id) AS hist_markets FROM tt GROUP BY 1),
 dp AS (SELECT market_id, volume / 20 AS book_usd FROM markets),
 wj AS (SELECT *, size_usd / market_avg AS ratio FROM tt JOIN av USING (market_id) JOIN hh USING (wallet) LEFT JOIN dp USING (market_id) WHERE size_usd >= CASE tier WHEN 't1' THEN 0.5 WHEN 't2' THEN 2.0 WHEN 't3' THEN 4.0 WHEN 't5' THEN 1.0 ELSE 500.0 END),
 ws AS (SELECT *, least(10.0, CASE WHEN hist_n <= 3 THEN 2 WHEN hist_n <= 10 THEN 1 ELSE 0 END + CASE WHEN ratio >= 9 THEN 3 WHEN ratio >= 3 THEN 1.5 ELSE 0 END
   + CASE WHEN hist_markets = 1 AND hist_n >= 3 THEN 2 WHEN hist_markets <= 2 AND hist_n >= 5 THEN 1 ELSE 0 END + CASE WHEN price > 0.88 OR price < 0.12 THEN 1 ELSE 0 END
   + CASE WHEN size_usd >= 50000 THEN 2 WHEN size_usd >= 10000 THEN 1 ELSE 0 END + CASE WHEN book_usd > 0 AND size_usd > book_usd * 0.25 THEN 1 ELSE 0 END)::double AS score FROM wj)"""


def whales(t):
    tiers = t.trades.join(t.markets.select("market_id", "tier"), "market_id")
    return A.whale_scores(tiers, t.markets.select("market_id", (F.col("volume") / 20).alias("book_usd")), None, 3.0, 1.0, MIN_USD)


@query("a17_whale_scores", f"""WITH {WHALE_SQL} SELECT event_id, wallet, round(size_usd, 4) AS size_usd, hist_n, hist_markets, score,
 (CASE WHEN hist_n <= 10 THEN 1 ELSE 0 END + CASE WHEN ratio >= 3 THEN 1 ELSE 0 END + CASE WHEN (hist_markets = 1 AND hist_n >= 3) OR (hist_markets <= 2 AND hist_n >= 5) THEN 1 ELSE 0 END + CASE WHEN price > 0.88 OR price < 0.12 THEN 1 ELSE 0 END
  + CASE WHEN size_usd >= 10000 THEN 1 ELSE 0 END + CASE WHEN book_usd > 0 AND size_usd > book_usd * 0.25 THEN 1 ELSE 0 END)::int AS n_flags FROM ws WHERE score >= 1""")
def _(t):
    return whales(t).select("event_id", "wallet", F.round("size_usd", 4).alias("size_usd"), "hist_n", "hist_markets", "score", F.size("flags").alias("n_flags"))


@query("a18_whale_entities", f"""WITH {WHALE_SQL} SELECT wallet, round(max(least(0.95, greatest(0.55, 0.55 + (score - 2) * 0.05))), 6) AS insider_score, count(*) AS sample_size FROM ws WHERE score >= 1 GROUP BY 1""")
def _(t):
    from tapewatch.sources import sinks as K

    rows = whales(t).select("wallet", F.col("ts_us").alias("updated_us"), A.whale_entity_score(F.col("score")).alias("insider_score"), F.lit(0).cast("long").alias("sample_size"))
    m = K.upsert(rows.limit(0), rows, ["wallet"], {"insider_score": K.MAXIMUM, "sample_size": K.COUNTER}, "updated_us")
    return m.select("wallet", F.round("insider_score", 6).alias("insider_score"), "sample_size")


@query("a19_promoted_wallets", f"""SELECT DISTINCT address AS wallet, 0.55::double AS insider_score FROM observations WHERE obs_type = 'clob_trade' AND ts_us >= {AS_OF_US - 5 * DAY} AND address NOT IN (SELECT wallet FROM entities WHERE insider_score > 0.3)""")
def _(t):
    return A.promoted_wallets(t.observations, t.entities.filter("insider_score > 0.3"), AS_OF_US - 5 * DAY).select("wallet", "insider_score")


ALERT_SQL = f"""b AS (SELECT * FROM fills WHERE usd >= 1),
 rp AS (SELECT *, count(*) OVER w AS n, sum(usd) OVER w AS v FROM b WINDOW w AS (PARTITION BY market_id, wallet, outcome ORDER BY ts_us RANGE BETWEEN {4 * DAY} PRECEDING AND CURRENT ROW)),
 wk AS (SELECT *, count(*) OVER w AS k, sum(CASE WHEN side = 'BUY' THEN usd ELSE 0 END) OVER w AS bv, sum(CASE WHEN side = 'SELL' THEN usd ELSE 0 END) OVER w AS sv, sum(usd) OVER w AS tv FROM b WINDOW w AS (PARTITION BY wallet ORDER BY ts_us RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW)),
 al AS (SELECT market_id, wallet, outcome, 'L1_LARGE $' || cast(round_even(usd, 0) AS bigint) AS trigger, event_id, ts_us, usd FROM b WHERE usd >= 40
  UNION ALL SELECT market_id, wallet, outcome, 'L2_RAPID x' || n || ' ' || outcome || ' $' || cast(round_even(round(v, 4), 0) AS bigint), event_id, ts_us, usd FROM rp WHERE n >= 2
  UNION ALL SELECT market_id, wallet, outcome, 'L3_WINRATE ' || cast(round_even(round(sv / bv * 100, 4), 0) AS bigint) || '% 7d=$' || cast(round_even(round(tv, 4), 0) AS bigint), event_id, ts_us, usd FROM wk WHERE k >= 5 AND bv > 0 AND sv / bv >= 0.7)"""


@query("w9_alert_layers", f"""WITH {FILLS}, {ALERT_SQL} SELECT market_id, wallet, arg_min(trigger, ts_us) AS trigger, arg_min(outcome, ts_us) AS outcome, min(ts_us) AS ts_us, arg_min(event_id, ts_us) AS event_id, arg_min(usd, ts_us) AS usd FROM al GROUP BY market_id, wallet, substr(trigger, 1, 25)""")
def _(t):
    return A.alerts(fills(t), 40.0, 4 * DAY, 2, 7 * DAY, 1.0, 0.7)


@query("w10_position_replay", f"""WITH RECURSIVE {FILLS}, f AS (SELECT *, row_number() OVER (PARTITION BY wallet, market_id ORDER BY ts_us, event_id) AS i, count(*) OVER (PARTITION BY wallet, market_id) AS n, max(ts_us) OVER (PARTITION BY wallet, market_id) AS updated_us FROM fills WHERE size > 0),
 r AS (SELECT wallet, market_id, i, n, updated_us, CASE WHEN side = 'BUY' THEN size ELSE 0.0 END AS q, CASE WHEN side = 'BUY' THEN price END AS a FROM f WHERE i = 1
  UNION ALL SELECT f.wallet, f.market_id, f.i, f.n, f.updated_us, CASE WHEN side = 'BUY' THEN q + size ELSE greatest(0.0, q - size) END, CASE WHEN side = 'BUY' THEN (coalesce(a, 0) * q + price * size) / (q + size) ELSE a END
   FROM r JOIN f ON f.wallet = r.wallet AND f.market_id = r.market_id AND f.i = r.i + 1)
 SELECT wallet, market_id, round(q, 4) + 0.0 AS quantity, round(a, 5) AS avg_entry_price, updated_us FROM r WHERE i = n AND a IS NOT NULL""")
def _(t):
    p = A.replay_positions(fills(t), 4 * DAY)
    return p.select("wallet", "market_id", F.round("quantity", 4).alias("quantity"), F.round("avg_entry_price", 5).alias("avg_entry_price"), "updated_us")


SERIES_POS_SQL = """sp AS (SELECT t.wallet, m.slug, any_value(m.brand) AS series_id, avg(price) AS p, sum(size) AS s, count(*) AS trade_count, min(ts_us) AS first_us, max(ts_us) AS last_us FROM trades t JOIN markets m USING (market_id) WHERE side = 'BUY' GROUP BY 1, 2),
 ex AS (SELECT t.wallet, m.slug, max(price) AS sell_ratio FROM trades t JOIN markets m USING (market_id) WHERE side = 'SELL' AND size > 20 GROUP BY 1, 2)"""


@query("w11_series_positions", f"""WITH {SERIES_POS_SQL} SELECT sp.wallet, sp.slug, round(p, 6) AS avg_entry_prob, round(s, 2) AS total_size, trade_count, first_us, last_us,
 CASE WHEN sell_ratio IS NULL THEN 'OPEN' WHEN round(1 - sell_ratio, 6) < 0.10 THEN 'CLOSED' ELSE 'PARTIALLY_CLOSED' END AS position_status, round(coalesce(s * (1 - sell_ratio), s), 4) AS remaining_size
 FROM sp LEFT JOIN ex USING (wallet, slug)""")
def _(t):
    m = t.markets.select("market_id", "slug", F.col("brand").alias("series_id"))
    tr = t.trades.join(m, "market_id")
    ex = tr.filter("side = 'SELL' and size > 20").groupBy("wallet", "slug").agg(F.max("price").alias("sell_ratio")).withColumn("exit_prob", F.col("sell_ratio"))
    p = A.series_positions(tr.filter("side = 'BUY'"), ex)
    return p.select(
        "wallet", "slug", F.round("avg_entry_prob", 6).alias("avg_entry_prob"), F.round("total_size", 2).alias("total_size"), "trade_count", "first_us", "last_us",
        "position_status", F.round("remaining_size", 4).alias("remaining_size"),
    )


@query("w19_smart_exits", f"""WITH {SCORES_SQL}, pos AS (SELECT wallet, market_id, sum(size) AS total, avg(price) AS ap FROM trades WHERE side = 'BUY' GROUP BY 1, 2)
 SELECT t.event_id, t.wallet, t.market_id, round(size / total, 6) AS sell_ratio, round(price - ap, 6) + 0.0 AS gap FROM trades t JOIN scores s USING (wallet) JOIN pos USING (wallet, market_id)
 WHERE side = 'SELL' AND price >= 0.7 AND score >= 0.6 AND size / total >= 0.3""")
def _(t):
    pos = t.trades.filter("side = 'BUY'").groupBy("wallet", "market_id").agg(F.sum("size").alias("total_size"), F.avg("price").alias("avg_entry_prob"))
    pos = pos.withColumn("side", F.lit("YES")).withColumn("position_status", F.lit("OPEN"))
    tr = t.trades.filter("side = 'SELL'").withColumn("trade_side", F.lit("SELL_YES"))
    e = A.smart_exits(tr, pos, scores(t))
    return e.select("event_id", "wallet", "market_id", F.round("sell_ratio", 6).alias("sell_ratio"), F.round("gap", 6).alias("gap"))


@query("w15_coverage_log", f"""WITH p AS (SELECT market_id, event_id, ts_us, cast(round(size) AS bigint) AS ws, cast(round(size * price) AS bigint) AS api FROM trades),
 r AS (SELECT *, sum(ws) OVER w AS tw, sum(api) OVER w AS ta FROM p WINDOW w AS (PARTITION BY market_id ORDER BY ts_us, event_id))
 SELECT event_id, market_id, round(CASE WHEN ws > 0 THEN greatest(0, 1 - api / ws) END, 6) AS loss_rate, round(CASE WHEN api > 0 THEN (api // 2) / api ELSE 0 END, 6) AS wallet_coverage, api >= 20 AS page_saturated,
  cast(tw AS bigint) AS total_ws, cast(ta AS bigint) AS total_api, round(CASE WHEN tw > 0 THEN greatest(0, 1 - ta / tw) END, 6) AS cumulative_loss FROM r""")
def _(t):
    api = F.round(F.col("size") * F.col("price")).cast("long")
    polls = t.trades.select(
        "market_id", F.col("event_id").alias("poll_id"), "ts_us", F.round("size").cast("long").alias("ws_ticks"), api.alias("api_received"),
        F.floor(api / 2).alias("api_with_wallet"), F.lit(20).alias("page_size"),
    )
    c = A.coverage_log(polls, 2 * DAY)
    r = lambda n: F.round(n, 6).alias(n)
    return c.select(F.col("poll_id").alias("event_id"), "market_id", r("loss_rate"), r("wallet_coverage"), "page_saturated", "total_ws", "total_api", r("cumulative_loss"))


@query("w17_receipt_states", """WITH o AS (SELECT market_id AS tx_hash, event_id AS seq, event_id % 7 <> 3 AS has_receipt, event_id % 11 <> 5 AS status_ok, 'h' || (user_k % 2) AS block_hash, 100 + user_k % 2 AS block_number, 100 + event_id % 9 AS head, event_id % 13 <> 4 AS log_ok
   FROM (SELECT *, cast(substr(wallet, 3) AS bigint) AS user_k FROM trades)),
 f AS (SELECT tx_hash, min(seq) AS s, arg_min(block_hash, seq) AS bh FROM o WHERE has_receipt AND status_ok GROUP BY 1),
 r AS (SELECT o.*, CASE WHEN NOT has_receipt AND s < seq THEN 'receipt_disappeared' WHEN NOT has_receipt THEN NULL WHEN NOT status_ok THEN 'receipt_reverted' WHEN s < seq AND block_hash <> bh THEN 'head_changed' WHEN NOT log_ok THEN 'exchange_log_mismatch' END AS failure_reason FROM o LEFT JOIN f USING (tx_hash)),
 c AS (SELECT *, CASE WHEN NOT has_receipt OR failure_reason IN ('receipt_reverted', 'head_changed') THEN 0 ELSE greatest(0, head - block_number + 1) END AS confirmations FROM r)
 SELECT seq, tx_hash, failure_reason, cast(confirmations AS bigint) AS confirmations, CASE WHEN failure_reason IN ('receipt_disappeared', 'head_changed') THEN 'reorg_suspected' WHEN failure_reason = 'receipt_reverted' THEN 'failed'
  WHEN failure_reason = 'exchange_log_mismatch' OR NOT has_receipt THEN 'pending' WHEN confirmations >= 5 THEN 'confirmed' ELSE 'pending' END AS settlement_status FROM c""")
def _(t):
    k = F.substring("wallet", 3, 40).cast("long") % 2
    e = F.col("event_id")
    o = t.trades.select(
        F.col("market_id").alias("tx_hash"), e.alias("seq"), (e % 7 != 3).alias("has_receipt"), (e % 11 != 5).alias("status_ok"),
        F.concat(F.lit("h"), k.cast("string")).alias("block_hash"), (k + 100).alias("block_number"), (e % 9 + 100).alias("head"), F.lit(5).alias("required"), (e % 13 != 4).alias("log_ok"),
    )
    return A.receipt_status(o).select("seq", "tx_hash", "failure_reason", F.col("confirmations").cast("long").alias("confirmations"), "settlement_status")


@query("a31_entity_trust", """WITH e AS (SELECT entity_id, avg(insider_score) AS wr, sum(sample_size) AS n, max(trust_score) FILTER (WHERE sample_size % 3 <> 0) AS prev FROM entities GROUP BY 1),
 g AS (SELECT *, CASE WHEN wr >= 0.47 THEN 'ALGO_SLICING' ELSE 'LONG_TERM_HOLDER' END AS primary_tag, least(1.0, n / 1600.0) AS k FROM e)
 SELECT entity_id, cast(n AS bigint) AS sample_size, primary_tag, round(greatest(0, least(1, (1 - k) * coalesce(prev / 100, 0.5) + k * (wr * 0.7 + CASE primary_tag WHEN 'ALGO_SLICING' THEN 0.75 ELSE 0.55 END * 0.3))) * 100, 3) AS trust_score FROM g""")
def _(t):
    g = t.entities.groupBy("entity_id").agg(F.avg("insider_score").alias("wr"), F.sum("sample_size").alias("n"), F.max(F.when(F.col("sample_size") % 3 != 0, F.col("trust_score"))).alias("prev"))
    tag = F.when(F.col("wr") >= 0.47, "ALGO_SLICING").otherwise("LONG_TERM_HOLDER")
    return g.withColumn("primary_tag", tag).select(
        "entity_id", F.col("n").alias("sample_size"), "primary_tag", A.trust_score(F.col("prev"), F.col("wr"), F.col("n") / 16, F.col("primary_tag")).alias("trust_score")
    )


@query("a29_candidate_wallets", """SELECT wallet, count(DISTINCT s.market_id) AS markets, round(sum(pnl), 2) AS pnl, round(avg(CASE WHEN trade_id % 3 = 0 THEN NULL ELSE s.entry_price END), 6) AS win_rate FROM
 (SELECT *, strategy || '/' || (trade_id % 50) AS wallet FROM settlements) s GROUP BY 1 HAVING count(DISTINCT s.market_id) > 20 AND coalesce(avg(CASE WHEN trade_id % 3 = 0 THEN NULL ELSE s.entry_price END), 0) >= 0.4 ORDER BY win_rate DESC, pnl DESC, markets DESC, wallet LIMIT 100""")
def _(t):
    rows = t.settlements.select(
        F.concat_ws("/", "strategy", (F.col("trade_id") % 50).cast("string")).alias("wallet"), "market_id", "pnl", F.when(F.col("trade_id") % 3 != 0, F.col("entry_price")).alias("win_rate")
    )
    c = A.candidate_wallets(rows, 20, 0.4, 100)
    return c.select("wallet", "markets", F.round("pnl", 2).alias("pnl"), F.round("win_rate", 6).alias("win_rate"))


@query("a30_leaderboard", f"""WITH {WALLET_PNL_SQL}, b AS (SELECT wallet, max(pnl) AS pnl FROM wp GROUP BY 1), n AS (SELECT count(*) FILTER (WHERE pnl > 249950) AS s, count(*) FILTER (WHERE pnl > 249500) AS r FROM b),
 lb AS (SELECT wallet, pnl, CASE WHEN pnl > 249950 THEN 'LEADERBOARD' WHEN pnl > 249500 AND s < 10 THEN 'LEADERBOARD_RELAXED' END AS discovery_source FROM b, n)
 SELECT * FROM lb WHERE discovery_source IS NOT NULL UNION ALL SELECT wallet, 0.0, 'RECENT_TRADER' FROM (SELECT DISTINCT wallet FROM trades), n WHERE CASE WHEN s < 10 THEN r ELSE s END < 50 AND wallet NOT IN (SELECT wallet FROM lb WHERE discovery_source IS NOT NULL)""")
def _(t):
    recent = t.trades.select("wallet").distinct().withColumn("pnl", F.lit(0.0))
    return A.leaderboard_candidates(wallet_pnl(t).withColumn("volume", F.lit(1.0)), recent, 249950.0, 249500.0, 10, 50)


TAKER_SQL = "ta AS (SELECT wallet, sum((price - 0.5) * size) AS pnl, 'CLOB_TAKER' AS discovery_source FROM trades WHERE asset_id IN (SELECT 't' || market_no || 'y' FROM markets WHERE volume > 5000) GROUP BY 1)"


def taker_rows(t):
    tokens = t.markets.filter("volume > 5000").select(F.concat(F.lit("t"), F.col("market_no").cast("string"), F.lit("y")).alias("asset_id"))
    return A.taker_candidates(t.trades.withColumn("pnl", (F.col("price") - 0.5) * F.col("size")), tokens)


@query("a47_taker_candidates", f"WITH {TAKER_SQL} SELECT wallet, round(pnl, 4) + 0.0 AS pnl, discovery_source FROM ta")
def _(t):
    return taker_rows(t).withColumn("pnl", F.round("pnl", 4))


@query("u2_track_merge", f"""WITH {TAKER_SQL}, {WALLET_PNL_SQL}, tb AS (SELECT wallet, max(pnl) AS pnl, 'LEADERBOARD' AS discovery_source FROM wp GROUP BY 1)
 SELECT coalesce(ta.wallet, tb.wallet) AS wallet, round(coalesce(ta.pnl, tb.pnl), 4) + 0.0 AS pnl, coalesce(ta.discovery_source, tb.discovery_source) AS discovery_source FROM ta FULL JOIN tb USING (wallet)""")
def _(t):
    b = wallet_pnl(t).groupBy("wallet").agg(F.max("pnl").alias("pnl"), F.lit("LEADERBOARD").alias("discovery_source"))
    return A.merge_tracks(taker_rows(t), b).select("wallet", F.round("pnl", 4).alias("pnl"), "discovery_source")


@query("a33_outcome_transitions", """WITH o AS (SELECT wallet, price > 0.5 AS win FROM trades WHERE event_type IN ('view', 'click') UNION ALL SELECT wallet, price > 0.45 FROM trades WHERE event_type = 'purchase'),
 p AS (SELECT wallet, count(*) FILTER (WHERE win) AS wins, count(*) AS trades FROM o GROUP BY 1), j AS (SELECT e.wallet, coalesce(wins, 0) AS wins, coalesce(trades, 0) AS trades, coalesce(wins / trades, 0) AS win_rate FROM entities e LEFT JOIN p USING (wallet) WHERE insider_score < 0.55)
 SELECT wallet, wins, trades, round(win_rate, 6) AS win_rate, CASE WHEN trades >= 5 AND win_rate >= 0.6 THEN 'SMART_MONEY_QUANT' WHEN trades >= 5 AND win_rate < 0.4 THEN 'NOISE' ELSE 'WATCHLIST_UNCERTAIN' END AS to_label FROM j""")
def _(t):
    out = lambda cut: F.when(F.col("price") > cut, "win").otherwise("loss").alias("outcome")
    shadow = t.trades.filter("event_type in ('view', 'click')").select("wallet", out(0.5))
    paper = t.trades.filter("event_type = 'purchase'").select(F.upper("wallet").alias("wallet"), out(0.45))
    return A.outcome_transitions(shadow, paper, t.entities.filter("insider_score < 0.55")).select("wallet", "wins", "trades", F.round("win_rate", 6).alias("win_rate"), "to_label")


@query("a34_bucket_lifecycle", f"""WITH {LABELS_SQL}, s AS (SELECT wallet, sample_size % 9 AS pt, sample_size AS vt, cast(floor(sample_size * insider_score) AS bigint) AS w, updated_us FROM entities)
 SELECT wallet, label, CASE WHEN pt >= 5 AND coalesce(label NOT IN ('MARKET_MAKER_NOISE', 'COORDINATED_SMURF'), false) THEN 'GRADUATE' WHEN vt >= 15 AND CASE WHEN vt > 0 THEN w / vt ELSE 1 END < 0.4 THEN 'EVICT'
  WHEN ({AS_OF_US} - updated_us) // {DAY} > 60 THEN 'ARCHIVE' ELSE 'KEEP' END AS transition FROM s LEFT JOIN lab USING (wallet)""")
def _(t):
    st = t.entities.select(
        "wallet", (F.col("sample_size") % 9).alias("profitable_trades"), F.col("sample_size").alias("verified_trades"),
        F.floor(F.col("sample_size") * F.col("insider_score")).alias("wins"), F.col("updated_us").alias("last_trade_us"),
    )
    return A.bucket_lifecycle(st, labels(t), AS_OF_US, idle_days=60).select("wallet", "label", "transition")


@query("a46_seed_ranking", f"""WITH {LABELS_SQL}, v AS (SELECT wallet, sum(size) AS v, count(*) AS n FROM trades GROUP BY 1)
 SELECT wallet, label, round(sqrt(v) / (1 + n * 0.05) * CASE WHEN wallet IN (SELECT wallet FROM funding WHERE nation < 8) THEN 0.35 ELSE 1 END + CASE label WHEN 'INSIDER_ALGO_SLICING' THEN 5 WHEN 'POTENTIAL_INSIDER' THEN 2 ELSE 0 END + idi * 2, 6) AS score
 FROM v JOIN lab USING (wallet) ORDER BY score DESC, wallet LIMIT 50""")
def _(t):
    vals = t.trades.select("wallet", F.col("size").alias("value"))
    return A.seed_ranking(vals, labels(t), t.funding.filter("nation < 8"), 50).withColumn("score", F.round("score", 6))


CURVE_SQL = """cv AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy ORDER BY closed_us, trade_id) AS equity FROM settlements),
 pk AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY strategy ORDER BY closed_us, trade_id)) AS peak FROM cv),
 dd AS (SELECT *, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS drawdown FROM pk)"""


@query("w12_equity_curve", f"WITH {CURVE_SQL} SELECT trade_id, strategy, round(equity, 2) + 0.0 AS equity, round(peak, 2) AS peak, round(drawdown, 6) + 0.0 AS drawdown FROM dd")
def _(t):
    c = PF.equity_curve(t.settlements, "strategy", 180 * DAY)
    return c.select("trade_id", "strategy", F.round("equity", 2).alias("equity"), F.round("peak", 2).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


@query("a5_performance", f"""WITH {CURVE_SQL}, mx AS (SELECT strategy, max(drawdown) AS m FROM dd GROUP BY 1),
 tr AS (SELECT strategy, arg_min(trade_id, (closed_us, trade_id)) AS to_trade_id, arg_min(peak, (closed_us, trade_id)) AS p FROM dd JOIN mx USING (strategy) WHERE drawdown = m GROUP BY 1),
 fr AS (SELECT tr.strategy, arg_min(trade_id, (closed_us, trade_id)) AS from_trade_id FROM dd JOIN tr ON dd.strategy = tr.strategy AND equity = p GROUP BY 1),
 ag AS (SELECT strategy, count(*) AS trade_count, sum(pnl) AS total_pnl, avg(pnl) AS mu, stddev_pop(pnl) AS sd, count(*) FILTER (WHERE pnl > 0) AS w, count(*) FILTER (WHERE pnl < 0) AS l, sum(pnl) FILTER (WHERE pnl > 0) AS gp, -sum(pnl) FILTER (WHERE pnl < 0) AS gl, avg(est - pnl) AS slippage_gap FROM settlements GROUP BY 1)
 SELECT strategy, trade_count, round(total_pnl, 2) + 0.0 AS total_pnl, round(w / (w + l), 6) AS win_rate, round(mu / sd * sqrt(trade_count), 6) + 0.0 AS sharpe, round(gp / gl, 6) AS profit_factor, round(slippage_gap, 4) + 0.0 AS slippage_gap,
  round(m, 6) AS max_drawdown, from_trade_id, to_trade_id FROM ag JOIN mx USING (strategy) JOIN tr USING (strategy) JOIN fr USING (strategy)""")
def _(t):
    p = PF.performance(t.settlements, "strategy", 180 * DAY)
    r = lambda n, k: F.round(n, k).alias(n)
    return p.select(
        "strategy", "trade_count", r("total_pnl", 2), r("win_rate", 6), r("sharpe", 6), r("profit_factor", 6), r("slippage_gap", 4), r("max_drawdown", 6), "from_trade_id", "to_trade_id"
    )


@query("a27_backtest_summary", """WITH n AS (SELECT *, count(*) OVER (PARTITION BY market_id) AS c FROM settlements),
 e AS (SELECT *, 200000 + sum(pnl) OVER (PARTITION BY market_id ORDER BY closed_us, trade_id) AS eq FROM n WHERE c >= 10), p AS (SELECT *, greatest(200000, max(eq) OVER (PARTITION BY market_id ORDER BY closed_us, trade_id)) AS pk FROM e)
 SELECT market_id, count(*) AS trades, round(avg(pnl) / stddev_pop(pnl) * sqrt(count(*)), 6) + 0.0 AS sharpe, round(greatest(0, max((pk - eq) / pk)), 4) AS max_drawdown, round(sum(pnl), 2) + 0.0 AS net_profit FROM p GROUP BY 1""")
def _(t):
    b = PF.backtest_summary(t.settlements, "market_id", 200000.0, None, 10)
    return b.select("market_id", "trades", F.round("sharpe", 6).alias("sharpe"), F.round("max_drawdown", 4).alias("max_drawdown"), F.round("net_profit", 2).alias("net_profit"))


@query("a4_readiness", f"""SELECT count(*) AS paper_trades, ({ORDERS_AS_OF_US} - min(closed_us)) // {DAY} AS running_days, round(count(*) FILTER (WHERE pnl > 0) / count(*) FILTER (WHERE pnl <> 0), 6) AS win_rate,
 count(*) >= 100 AND count(*) FILTER (WHERE pnl > 0) / count(*) FILTER (WHERE pnl <> 0) > 0.55 AS is_ready FROM settlements""")
def _(t):
    return PF.readiness(t.settlements, ORDERS_AS_OF_US).withColumn("win_rate", F.round("win_rate", 6))


@query("a4_readiness_verdict", """WITH e AS (SELECT count(*) AS trade_count FROM executions WHERE mode = 'PAPER' AND accepted = 1), s AS (SELECT count(*) FILTER (WHERE pnl > 0) / count(*) FILTER (WHERE pnl <> 0) AS wr, avg(est) AS ev FROM settlements),
 k AS (SELECT count(*) AS n, count(DISTINCT asset_id) AS a FROM trades WHERE size > 1)
 SELECT trade_count, round(wr, 6) AS win_rate, round(ev, 3) AS avg_ev, n AS impact_samples, a AS impact_assets, CASE WHEN n >= 500 AND a >= 10 THEN 'primary' WHEN n >= 50 AND a >= 3 THEN 'fallback' ELSE 'accumulating' END AS impact_mode,
  trade_count >= 100 AND wr >= 0.5 AND ev > 0 AND n >= 50 AND a >= 3 AS is_ready FROM e, s, k""")
def _(t):
    v = PF.readiness_verdict(t.executions, t.settlements, t.trades.filter("size > 1"), win_rate_needed=0.5)
    return v.withColumn("win_rate", F.round("win_rate", 6)).withColumn("avg_ev", F.round("avg_ev", 3))


@query("w14_tick_pnl", """SELECT event_id, asset_id, round((price - pp) * greatest(size, 1), 4) + 0.0 AS pnl, CASE WHEN price >= 0.5 THEN 'YES' ELSE 'NO' END AS direction
 FROM (SELECT *, lag(price) OVER (PARTITION BY asset_id ORDER BY ts_us, event_id) AS pp FROM trades) WHERE pp IS NOT NULL""")
def _(t):
    return PF.tick_pnl(t.trades, 2 * DAY).select("event_id", "asset_id", F.round("pnl", 4).alias("pnl"), "direction")


HYBRID_SQL = f"""{PRICE_SQL}, hy AS (SELECT 'open-' || position_id AS row_id, h.market_id, 'open' AS status, side AS direction, 0.0::double AS realized, (CASE WHEN side = 'YES' THEN 1 ELSE -1 END) * (coalesce(settlement_price, 0.5) - 0.5) * CASE WHEN signed_usd <> 0 THEN abs(signed_usd) ELSE 50 END AS unrealized, opened_us AS updated_us
  FROM holdings h LEFT JOIN prices USING (market_id) UNION ALL SELECT cast(trade_id AS varchar), market_id, 'closed', direction, pnl, 0.0, closed_us FROM settlements)"""


def hybrid(t):
    return PF.hybrid_rows(t.holdings, prices(t).withColumnRenamed("settlement_price", "mark"), t.settlements)


@query("u1_hybrid_rows", f"WITH {HYBRID_SQL} SELECT row_id, market_id, status, direction, realized, round(unrealized, 4) + 0.0 AS unrealized, updated_us FROM hy")
def _(t):
    return hybrid(t).select("row_id", "market_id", "status", "direction", "realized", F.round("unrealized", 4).alias("unrealized"), "updated_us")


@query("a41_live_report", f"""WITH {HYBRID_SQL}, a AS (SELECT count(*) FILTER (WHERE status = 'open') AS open_trades, count(*) FILTER (WHERE status = 'closed') AS closed_trades, sum(realized) AS r, sum(unrealized) AS u, count(DISTINCT market_id) AS unique_markets FROM hy),
 l AS (SELECT count(*) FILTER (WHERE event_slug <> '') AS m, count(*) FILTER (WHERE coalesce(event_slug, '') = '') AS x FROM link_map)
 SELECT open_trades, closed_trades, unique_markets, round(r, 2) AS realized_total, round(u, 2) + 0.0 AS unrealized_total, round(r + u, 2) AS net_total, round(m / greatest(1, m + x), 6) AS hit_rate,
  concat_ws(',', CASE WHEN x / (m + x) > 0.5 THEN 'many_fallback_links' END, CASE WHEN u < 0 THEN 'unrealized_loss' END, CASE WHEN x > 0 THEN 'unresolved_links' END) AS findings FROM a, l""")
def _(t):
    has = F.coalesce("event_slug", F.lit("")) != ""
    links = t.link_map.agg(F.count_if(has).alias("mapped"), F.count_if(~has).alias("unresolved"))
    r = PF.live_report(hybrid(t), links)
    n = lambda c, k: F.round(c, k).alias(c)
    return r.select("open_trades", "closed_trades", "unique_markets", n("realized_total", 2), n("unrealized_total", 2), n("net_total", 2), n("hit_rate", 6), F.array_join("findings", ",").alias("findings"))
