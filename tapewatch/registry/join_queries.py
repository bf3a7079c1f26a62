"""Registered join queries."""

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators import joins as J
from tapewatch.operators import predicates as P
from tapewatch.operators import scalars as S
from tapewatch.operators.sequence import DAY, HOUR
from tapewatch.registry.micro import FILLS, fills
from tapewatch.sources.bindings import AS_OF_US, ORDERS_AS_OF_US

BASE_URL = "https://venue.example"


@query("j2_observations_with_link", """SELECT obs_id, o.asset_id, l.token_id, l.event_slug, l.market_tier FROM observations o JOIN link_map l ON lower(o.asset_id) = lower(l.token_id) WHERE l.market_tier IN ('t1', 't2')""")
def _(t):
    links = t.link_map.filter("market_tier in ('t1', 't2')")
    return J.with_link(t.observations, links).select("obs_id", "asset_id", "token_id", "event_slug", "market_tier")


@query("j3_slug_resolution", """WITH ids AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN wallet WHEN 1 THEN '' ELSE asset_id END AS id FROM trades)
 SELECT event_id, coalesce(CASE WHEN l.event_slug <> '' THEN l.event_slug END, CASE WHEN id = '' THEN 'unknown' WHEN length(id) > 16 THEN substr(id, 1, 16) || '...' ELSE id END) AS slug
 FROM ids LEFT JOIN link_map l ON lower(l.token_id) = lower(id)""")
def _(t):
    k = F.col("event_id") % 4
    ids = t.trades.select("event_id", F.when(k == 0, F.col("wallet")).when(k == 1, "").otherwise(F.col("asset_id")).alias("id"))
    return J.resolve_slugs(ids, t.link_map, "id").select("event_id", "slug")


@query("j4_link_resolution", f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE market_id END AS market_id, upper(asset_id) AS token_id, 'ev ' || event_id AS event_name FROM trades),
 u AS (SELECT * FROM link_map WHERE event_slug <> '')
 SELECT event_id, CASE WHEN coalesce(m.event_slug, k.event_slug) IS NULL THEN 'search_fallback' ELSE 'canonical_event' END AS link_type,
  CASE WHEN m.event_slug IS NOT NULL THEN 'market_id' WHEN k.event_slug IS NOT NULL THEN 'token_id' ELSE 'fallback' END AS resolved_by,
  coalesce(m.market_id, k.market_id) AS canonical_id,
  CASE WHEN coalesce(m.event_slug, k.event_slug) IS NULL THEN '{BASE_URL}/search?q=ev%20' || event_id ELSE '{BASE_URL}/event/' || coalesce(m.event_slug, k.event_slug) END AS url
 FROM r LEFT JOIN u m ON m.market_id = r.market_id LEFT JOIN u k ON k.token_id = r.token_id""")
def _(t):
    req = t.trades.select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("market_id")).alias("market_id"), F.upper("asset_id").alias("token_id"),
        F.concat(F.lit("ev "), F.col("event_id").cast("string")).alias("event_name"),
    )
    return J.resolve_links(req, t.link_map, BASE_URL).select("event_id", "link_type", "resolved_by", "canonical_id", "url")


STATS = "count(*) AS total_signals, count(*) FILTER (WHERE accepted = 1) AS accepted, max(created_us) AS last_us, avg(ev_net) FILTER (WHERE accepted = 1) AS avg_ev, avg(posterior) FILTER (WHERE accepted = 1) AS avg_posterior"


@query("j5_watchlist_stats", f"""WITH s AS (SELECT market_id, {STATS} FROM executions WHERE created_us > {ORDERS_AS_OF_US} - 2400 * {HOUR} GROUP BY 1)
 SELECT m.market_id, coalesce(total_signals, 0) AS total_signals, coalesce(accepted, 0) AS accepted, last_us, round(avg_ev, 6) + 0.0 AS avg_ev, round(avg_posterior, 6) AS avg_posterior
 FROM markets m LEFT JOIN s USING (market_id) WHERE active""")
def _(t):
    w = J.watchlist_with_stats(t.markets.filter("active").select("market_id"), t.executions, ORDERS_AS_OF_US, 2400)
    return w.select("market_id", "total_signals", "accepted", "last_us", F.round("avg_ev", 6).alias("avg_ev"), F.round("avg_posterior", 6).alias("avg_posterior"))


def settled_with_gaps(t):
    s = t.settlements
    return s.withColumn("confidence", F.when(F.col("trade_id") % 3 == 0, F.col("entry_price"))).withColumn(
        "open_reason", F.when(F.col("trade_id") % 4 == 0, F.col("reason"))
    )


@query("j6_trade_candidates", f"""WITH s AS (SELECT trade_id, market_id, CASE WHEN trade_id % 3 = 0 THEN entry_price END AS confidence, CASE WHEN trade_id % 4 = 0 THEN reason END AS open_reason, pnl, closed_us FROM settlements
   WHERE closed_us >= {ORDERS_AS_OF_US - 300 * DAY} ORDER BY closed_us DESC, trade_id LIMIT 40),
 p AS (SELECT trade_id, 'paper-' || strategy AS paper_reason FROM settlements WHERE trade_id % 2 = 0), d AS (SELECT trade_id, 0.25::double AS posterior, 'BUY' AS action FROM settlements WHERE trade_id % 5 <> 0)
 SELECT s.trade_id, s.market_id, coalesce(confidence, posterior, 0.0) AS confidence, coalesce(open_reason, paper_reason, action, 'N/A') AS open_reason, pnl
 FROM s LEFT JOIN p USING (trade_id) LEFT JOIN d USING (trade_id)""")
def _(t):
    paper = t.settlements.filter("trade_id % 2 = 0").select("trade_id", F.concat(F.lit("paper-"), "strategy").alias("reason"))
    dec = t.settlements.filter("trade_id % 5 <> 0").select("trade_id", F.lit(0.25).alias("posterior"), F.lit("BUY").alias("action"))
    c = J.trade_candidates(settled_with_gaps(t), paper, dec, ORDERS_AS_OF_US, 300, 40)
    return c.select("trade_id", "market_id", "confidence", "open_reason", "pnl")


PRICE_SQL = "prices AS (SELECT market_id, last_p, CASE WHEN last_p >= 0.95 THEN 1.0 WHEN last_p <= 0.05 THEN 0.0 ELSE last_p END AS settlement_price FROM (SELECT market_id, arg_max(price, ts_us) AS last_p FROM trades GROUP BY 1))"


def prices(t):
    return P.settlement_prices(t.trades, "market_id", ["ts_us", "event_id"]).select("market_id", "settlement_price")


@query("j7_new_settlements", f"""WITH {PRICE_SQL}, done AS (SELECT DISTINCT execution_id FROM executions WHERE order_no % 3 = 0)
 SELECT execution_id, market_id, CASE WHEN posterior >= 0.5 THEN 'YES' ELSE 'NO' END AS direction, settlement_price AS exit_price, round(coalesce((settlement_price - entry_price) * qty, ev_net), 5) + 0.0 AS pnl
 FROM executions LEFT JOIN prices USING (market_id) WHERE mode = 'PAPER' AND accepted = 1 AND execution_id NOT IN (SELECT execution_id FROM done)""")
def _(t):
    done = t.executions.filter("order_no % 3 = 0").select("execution_id")
    n = J.new_settlements(t.executions, done, prices(t))
    return n.select("execution_id", "market_id", "direction", "exit_price", F.round("pnl", 5).alias("pnl"))


@query("j7_backfill_exits", f"""WITH {PRICE_SQL} SELECT trade_id, settlement_price AS exit_price, round((settlement_price - entry_price) * position_usd, 4) + 0.0 AS pnl
 FROM settlements JOIN prices USING (market_id) WHERE exit_price IS NULL""")
def _(t):
    b = J.backfill_exits(t.settlements, prices(t))
    return b.select("trade_id", "exit_price", F.round("pnl", 4).alias("pnl"))


@query("j8_deactivate_missing", """SELECT market_id, active AND market_id IN (SELECT market_id FROM trades) AS is_active FROM markets""")
def _(t):
    w = t.markets.select("market_id", F.col("active").alias("is_active"))
    return J.deactivate_missing(w, t.trades.select("market_id"))


@query("j9_markets_without_slug", f"""WITH r AS (SELECT DISTINCT market_id FROM executions WHERE created_us >= {ORDERS_AS_OF_US - 300 * DAY}),
 g AS (SELECT market_id FROM link_map WHERE source NOT IN ('fallback', 'stale') AND event_slug <> '' AND NOT ends_with(event_slug, '...'))
 SELECT market_id AS market_key, market_id IN (SELECT market_id FROM link_map) AS has_row FROM r WHERE market_id NOT IN (SELECT market_id FROM g)""")
def _(t):
    return J.markets_without_slug(t.executions, t.link_map, ORDERS_AS_OF_US, 300)


@query("j10_basket_activity", f"""WITH {FILLS} SELECT event_id, wallet FROM fills WHERE {AS_OF_US} - ts_us <= {10 * DAY} AND wallet IN (SELECT wallet FROM entities WHERE insider_score >= 0.55)""")
def _(t):
    return J.basket_activity(fills(t), t.entities.filter("insider_score >= 0.55"), AS_OF_US, 10 * DAY).select("event_id", "wallet")


@query("j11_observation_injection", """WITH b AS (SELECT wallet, arg_max(asset_id, least(10.0, 0.5 + size * price / 5000.0 * 0.5)) AS asset_id, max(least(10.0, 0.5 + size * price / 5000.0 * 0.5)) AS s FROM trades GROUP BY 1)
 SELECT wallet, asset_id, round(s, 8) AS whale_score FROM b WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.address = wallet AND o.asset_id = b.asset_id AND obs_id % 2 = 0)""")
def _(t):
    stored = t.observations.filter("obs_id % 2 = 0")
    return J.observations_to_inject(t.trades, stored).select("wallet", "asset_id", F.round("whale_score", 8).alias("whale_score"))


SCORES_SQL = """scores AS (SELECT e.wallet, coalesce(sn.s, CASE WHEN e.insider_score > 0.3 THEN e.insider_score END, e.trust_score / 100) AS score FROM entities e
 LEFT JOIN (SELECT wallet, arg_max(price, ts_us) AS s FROM trades WHERE event_type = 'signup' GROUP BY 1) sn USING (wallet))"""


def scores(t):
    snap = t.trades.filter("event_type = 'signup'").select("wallet", F.col("price").alias("score"), "ts_us")
    return J.insider_scores(t.entities, snap, t.entities.filter("insider_score > 0.3"), t.entities)


@query("j12_insider_scores", f"WITH {SCORES_SQL} SELECT wallet, round(score, 6) AS score FROM scores")
def _(t):
    return scores(t).select("wallet", F.round("score", 6).alias("score"))


SIGNALS_SQL = "signals AS (SELECT event_id AS signal_id, market_id, ts_us AS signal_us, wallet FROM trades WHERE event_type = 'purchase')"
MEMBERS_SQL = "members AS (SELECT market_id, regexp_replace(slug, '-(\\d{9,11})$', '') || brand AS series_id FROM markets WHERE regexp_matches(slug, '-(\\d{9,11})$'))"
SOURCES_SQL = f"""{SCORES_SQL}, {SIGNALS_SQL}, {MEMBERS_SQL},
 w AS (SELECT s.*, coalesce(sib.market_id, s.market_id) AS src FROM signals s LEFT JOIN members m ON m.market_id = s.market_id LEFT JOIN members sib ON sib.series_id = m.series_id),
 src AS (SELECT DISTINCT signal_id, o.address AS wallet, score FROM w JOIN observations o ON o.market_id = w.src AND o.ts_us BETWEEN w.signal_us - {DAY} AND w.signal_us
   JOIN scores c ON c.wallet = o.address WHERE score >= 0.55 AND o.address <> '0x0000000000000000000000000000000000000000')"""


def signals(t):
    return t.trades.filter("event_type = 'purchase'").select(F.col("event_id").alias("signal_id"), "market_id", F.col("ts_us").alias("signal_us"), "wallet")


def rolling_members(t):
    m = t.markets.filter(S.window_stamp(F.col("slug")) > 0)
    return m.select("market_id", F.concat(S.rolling_prefix(F.col("slug")), "brand").alias("series_id"), F.lit("ROLLING_WINDOW").alias("series_type"))


@query("j13_consensus_sources", f"WITH {SOURCES_SQL} SELECT signal_id, wallet, round(score, 6) AS score FROM src")
def _(t):
    s = J.consensus_sources(signals(t), t.observations, scores(t), rolling_members(t), DAY)
    return s.select("signal_id", "wallet", F.round("score", 6).alias("score"))


@query("j14_consensus_ready", f"""SELECT market_id, count(DISTINCT address) AS wallet_count, max(ts_us) AS last_us FROM observations JOIN entities ON wallet = address
 WHERE insider_score >= 0.55 AND ts_us > {AS_OF_US - 10 * DAY} GROUP BY 1 HAVING count(DISTINCT address) >= 3""")
def _(t):
    return J.consensus_ready(t.since("observations", AS_OF_US - 10 * DAY), t.entities, AS_OF_US - 10 * DAY, 3)


CATALYST_SQL = "catalysts AS (SELECT event_id AS catalyst_id, market_id, ts_us AS catalyst_us, price AS prob_before FROM trades WHERE event_type = 'view')"


@query("j15_pre_catalyst_wallets", f"""WITH {CATALYST_SQL},
 h AS (SELECT c.catalyst_id, c.market_id, t.wallet, count(*) AS trade_count, avg(price) AS p, sum(size) AS s, min(ts_us) AS first_us, max(ts_us) AS last_us
   FROM catalysts c JOIN trades t ON t.market_id = c.market_id AND t.ts_us >= c.catalyst_us - {8 * DAY} AND t.ts_us < c.catalyst_us
   WHERE prob_before <= 0.25 AND outcome = 'YES' AND price <= 0.25 GROUP BY ALL HAVING count(*) >= 2)
 SELECT catalyst_id, market_id, h.wallet, trade_count, round(p, 6) AS avg_entry_prob, round(s, 2) AS total_size, first_us, last_us,
   round(CASE WHEN insider_score < 0.55 THEN least(insider_score + 0.08, 0.85) ELSE insider_score END, 6) AS new_score
 FROM h JOIN entities USING (wallet) QUALIFY row_number() OVER (PARTITION BY catalyst_id ORDER BY trade_count DESC, round(s, 2) DESC, h.wallet) <= 50""")
def _(t):
    c = t.trades.filter("event_type = 'view'").select(
        F.col("event_id").alias("catalyst_id"), "market_id", F.col("ts_us").alias("catalyst_us"), F.col("price").alias("prob_before")
    )
    w = J.pre_catalyst_wallets(c, t.trades, lookback_us=8 * DAY).join(t.entities.select("wallet", "insider_score"), "wallet")
    return w.select(
        "catalyst_id", "market_id", "wallet", "trade_count", F.round("avg_entry_prob", 6).alias("avg_entry_prob"), F.round("total_size", 2).alias("total_size"),
        "first_us", "last_us", F.round(J.bumped_score(F.col("insider_score")), 6).alias("new_score"),
    )


def bets(t):
    return t.trades.select(F.col("event_id").alias("bet_id"), "wallet", "market_id", "ts_us", F.col("size").alias("stake"))


@query("j16_similar_stakes", f"""WITH a AS (SELECT wallet, min(ts_us) AS f FROM trades GROUP BY 1)
 SELECT b.event_id AS bet_id, count(o.event_id) AS n_obs, count(DISTINCT o.wallet) AS n_wallets FROM trades b LEFT JOIN (SELECT t.*, f FROM trades t JOIN a USING (wallet)) o
  ON o.market_id = b.market_id AND o.wallet <> b.wallet AND o.ts_us > b.ts_us - {2 * DAY} AND o.ts_us <= b.ts_us AND o.size BETWEEN b.size * (1 - 0.2) AND b.size * (1 + 0.2) AND b.ts_us - o.f <= {20 * DAY}
 GROUP BY 1""")
def _(t):
    return J.similar_stakes(bets(t), 2 * DAY, 0.20, 20 * DAY)


@query("j17_same_time_bets", f"""WITH l AS (SELECT wallet, market_id, max(ts_us) AS ts_us, arg_max(size, ts_us) AS s FROM trades GROUP BY 1, 2)
 SELECT l.wallet, l.market_id, count(o.event_id) AS same_ts_bets FROM l LEFT JOIN trades o ON o.market_id = l.market_id AND o.wallet <> l.wallet
  AND abs(o.ts_us - l.ts_us) <= {12 * HOUR} AND o.size BETWEEN l.s * (1 - 0.2) AND l.s * (1 + 0.2) GROUP BY 1, 2""")
def _(t):
    return J.same_time_bets(bets(t), 12 * HOUR)


TAKERS_SQL = f"""takers AS (SELECT market_id || '/' || ts_us // {DAY} AS shock_id, wallet, side, ts_us FROM trades)"""


def takers(t):
    return t.trades.select(F.concat_ws("/", "market_id", F.floor(F.col("ts_us") / DAY).cast("string")).alias("shock_id"), "wallet", "side", "ts_us")


TEMPORAL_SQL = f"""temporal AS (SELECT a.shock_id, a.wallet AS wallet_a, b.wallet AS wallet_b, max((1 - abs(a.ts_us - b.ts_us) / {float(2 * HOUR)}) * 0.8) AS weight FROM takers a JOIN takers b
  ON a.shock_id = b.shock_id AND a.side = b.side AND a.wallet < b.wallet AND abs(a.ts_us - b.ts_us) <= {2 * HOUR} GROUP BY 1, 2, 3)"""
FUNDED_SQL = """roots AS (SELECT wallet, root_a AS root FROM funding UNION SELECT wallet, root_b FROM funding WHERE root_b IS NOT NULL), memb AS (SELECT DISTINCT shock_id, wallet, root FROM takers JOIN roots USING (wallet)),
 funded AS (SELECT DISTINCT a.shock_id, a.wallet AS wallet_a, b.wallet AS wallet_b, 1.0::double AS weight FROM memb a JOIN memb b ON a.shock_id = b.shock_id AND a.root = b.root AND a.wallet < b.wallet)"""


def roots(t):
    return t.funding.select("wallet", F.array_compact(F.array("root_a", "root_b")).alias("roots"))


@query("j18_temporal_pairs", f"WITH {TAKERS_SQL}, {TEMPORAL_SQL} SELECT shock_id, wallet_a, wallet_b, round(weight, 6) AS weight FROM temporal")
def _(t):
    return J.temporal_pairs(takers(t), 2 * HOUR).withColumn("weight", F.round("weight", 6))


@query("j19_funding_pairs", f"WITH {TAKERS_SQL}, {FUNDED_SQL} SELECT shock_id, wallet_a, wallet_b, weight FROM funded")
def _(t):
    return J.funding_pairs(takers(t), roots(t))


@query("j20_shared_market_pairs", """WITH h AS (SELECT DISTINCT address AS wallet, market_id FROM observations)
 SELECT a.wallet AS wallet_a, b.wallet AS wallet_b, count(*) AS shared_markets FROM h a JOIN h b ON a.market_id = b.market_id AND a.wallet < b.wallet GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    o = t.observations.select(F.col("address").alias("wallet"), "market_id")
    return J.shared_market_pairs(o)


PAIRS_SQL = "pairs AS (SELECT DISTINCT a.wallet AS wallet_a, b.wallet AS wallet_b FROM funding a JOIN funding b ON a.root_a = b.root_a AND a.wallet <> b.wallet)"


@query("j21_sync_scores", f"""WITH {PAIRS_SQL}, h AS (SELECT wallet_a, wallet_b, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM trades b WHERE b.wallet = wallet_b AND abs(b.ts_us - a.ts_us) <= {3 * HOUR})) AS hits
  FROM pairs JOIN trades a ON a.wallet = wallet_a GROUP BY 1, 2)
 SELECT p.wallet_a, p.wallet_b, round(coalesce(hits, 0) / greatest(coalesce(n, 1), 1), 6) AS sync FROM pairs p LEFT JOIN h USING (wallet_a, wallet_b)""")
def _(t):
    return J.sync_scores(J.root_pairs(t.funding), t.trades, 3 * HOUR).withColumn("sync", F.round("sync", 6))


SYNC_US = HOUR // 12
SYNC_PAIRS_SQL = f"""st AS (SELECT DISTINCT wallet, ts_us, (SELECT count(*) FROM trades x WHERE x.wallet = t.wallet) AS n FROM trades t),
 hit AS (SELECT a.wallet AS wallet_a, b.wallet AS wallet_b, any_value(a.n) AS n, count(DISTINCT a.ts_us) AS hits FROM st a JOIN st b ON a.wallet <> b.wallet AND b.ts_us BETWEEN a.ts_us - {SYNC_US} AND a.ts_us + {SYNC_US} GROUP BY 1, 2),
 synced AS (SELECT wallet_a, wallet_b, hits / n AS sync FROM hit WHERE hits / n >= 0.06)"""


@query("j21_sync_pairs", f"WITH {SYNC_PAIRS_SQL} SELECT wallet_a, wallet_b, round(sync, 6) AS sync FROM synced")
def _(t):
    return J.sync_pairs(t.trades, SYNC_US, 0.06).withColumn("sync", F.round("sync", 6))


@query("j23_fires_vs_trades", f"""WITH f AS (SELECT ts_us // {HOUR} * {HOUR} AS bucket_us, count(*) AS fires FROM trades WHERE event_type = 'purchase' GROUP BY 1),
 p AS (SELECT ts_us // {HOUR} * {HOUR} AS bucket_us, count(*) AS n FROM trades WHERE event_type = 'click' GROUP BY 1)
 SELECT bucket_us, fires, coalesce(n, 0) AS paper_trades FROM f LEFT JOIN p USING (bucket_us)""")
def _(t):
    return J.fires_against_trades(t.trades.filter("event_type = 'purchase'"), t.trades.filter("event_type = 'click'"), HOUR)


@query("j24_market_cooccurrence", """SELECT * FROM (SELECT market_id, count(DISTINCT address) AS wallets FROM observations WHERE obs_type = 'clob_trade' GROUP BY 1 HAVING count(DISTINCT address) >= 2)
 JOIN (SELECT market_id, count(DISTINCT obs_id) AS events FROM observations WHERE obs_type = 'whale_scan' GROUP BY 1) USING (market_id)""")
def _(t):
    return J.market_cooccurrence(t.observations, "clob_trade", "whale_scan")


@query("j25_shock_routing", """SELECT event_id, coin, market_id FROM lead_trades JOIN (SELECT 'BTC' || (market_no % 40) AS coin, market_id FROM markets WHERE active) USING (coin) WHERE size > 30""")
def _(t):
    m = t.markets.filter("active").select(F.concat(F.lit("BTC"), (F.col("market_no") % 40).cast("string")).alias("coin"), "market_id")
    return J.route_shocks(t.lead_trades.filter("size > 30").select("event_id", "coin"), m)


LEGS_SQL = f"""asks AS (SELECT event_id, market_id, ts_us, outcome, price AS ask, size * 10 AS ask_size FROM trades),
 legs AS (SELECT *, last_value(CASE WHEN outcome = 'YES' THEN ask END IGNORE NULLS) OVER w AS yp, last_value(CASE WHEN outcome = 'YES' THEN ask_size END IGNORE NULLS) OVER w AS ys,
   last_value(CASE WHEN outcome = 'NO' THEN ask END IGNORE NULLS) OVER w AS np, last_value(CASE WHEN outcome = 'NO' THEN ask_size END IGNORE NULLS) OVER w AS ns,
   last_value(CASE WHEN outcome = 'YES' THEN ts_us END IGNORE NULLS) OVER w AS yt, last_value(CASE WHEN outcome = 'NO' THEN ts_us END IGNORE NULLS) OVER w AS nt
   FROM asks WINDOW w AS (PARTITION BY market_id ORDER BY ts_us, event_id)),
 arbs AS (SELECT market_id, event_id, ts_us, round(yp + np, 4) AS total, least(ys, ns) AS depth, round((1 - (yp + np)) * 100, 4) AS profit_per_100 FROM legs
   WHERE ts_us - greatest(yt, nt) <= {DAY} AND round(yp + np, 6) < 0.97 AND least(ys, ns) >= 50)"""


def arbs(t):
    asks = t.trades.select("event_id", "market_id", "ts_us", "outcome", F.col("price").alias("ask"), (F.col("size") * 10).alias("ask_size"))
    return J.arbitrage_legs(asks, max_total=0.97, slice_us=2 * DAY)


@query("j26_arbitrage_legs", f"WITH {LEGS_SQL} SELECT * FROM arbs")
def _(t):
    return arbs(t).select("market_id", "event_id", "ts_us", F.round("total", 4).alias("total"), "depth", "profit_per_100")


@query("j27_merged_market_stats", """SELECT market_id, coalesce(a, 0) AS total_evaluations, coalesce(b, 0) AS total_paper, coalesce(c, 0) AS passed_paper, coalesce(d, 0) AS impact_samples FROM
 (SELECT market_id, count(*) AS a FROM executions WHERE reason = 'low_ev' GROUP BY 1) FULL JOIN (SELECT market_id, count(*) AS b, count(*) FILTER (WHERE accepted = 1) AS c FROM executions WHERE mode = 'PAPER' GROUP BY 1) USING (market_id)
 FULL JOIN (SELECT market_id, count(*) AS d FROM trades GROUP BY 1) USING (market_id)""")
def _(t):
    e = t.executions
    return J.merged_market_stats(e.filter("reason = 'low_ev'"), e.filter("mode = 'PAPER'"), t.trades)


@query("j29_seed_overlap", """SELECT DISTINCT wallet FROM funding WHERE root_a IN (SELECT root_b FROM funding WHERE nation = 7) OR root_b IN (SELECT root_b FROM funding WHERE nation = 7)""")
def _(t):
    return J.seed_overlap(roots(t), t.funding.filter("nation = 7 and root_b is not null").select(F.col("root_b").alias("address")))
