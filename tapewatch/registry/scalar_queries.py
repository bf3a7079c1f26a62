"""Registered scalar-function and decision queries."""

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators import decisions as D
from tapewatch.operators import scalars as S
from tapewatch.sources.bindings import AS_OF_US, US

DEADLINE_SQL = "regexp_replace(regexp_replace(slug, '-(by-)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(uary|ruary|ch|il|e|y|ust|tember|ober|ember)?-?\\d*(-\\d{4})?$', '', 'i'), '-+$', '')"
STAMP_SQL = "coalesce(try_cast(nullif(regexp_extract(slug, '-(\\d{9,11})$', 1), '') AS bigint), 0)"


@query("x1_slug_parts", f"""SELECT market_id, {STAMP_SQL} AS window_ts, regexp_replace(slug, '-(\\d{{9,11}})$', '') AS rolling_prefix, {DEADLINE_SQL} AS deadline_prefix FROM markets""")
def _(t):
    s = F.col("slug")
    return t.markets.select(
        "market_id", S.window_stamp(s).alias("window_ts"), S.rolling_prefix(s).alias("rolling_prefix"), S.deadline_prefix(s).alias("deadline_prefix")
    )


@query("x2_window_slugs", """WITH w AS (SELECT DISTINCT ts_us // 300000000 * 300 AS window_ts FROM trades)
 SELECT window_ts, p || '-updown-5m-' || (window_ts + 300 * k) AS slug FROM w, (VALUES ('btc'), ('eth'), ('sol')) q(p), (VALUES (0), (1), (2)) v(k)""")
def _(t):
    starts = t.trades.select(S.window_start(F.col("ts_us") / US).alias("window_ts")).distinct()
    return S.window_slugs(starts, "window_ts", 3)


@query("x3_stale_windows", f"""SELECT market_id, slug FROM markets WHERE NOT (contains(slug, 'updown-5m') AND {STAMP_SQL} > 0 AND {STAMP_SQL} < {AS_OF_US // US + 60000} - 300)""")
def _(t):
    return t.markets.filter(S.live_windows(F.col("slug"), F.lit(AS_OF_US // US + 60000))).select("market_id", "slug")


@query("x4_payload_paths", """SELECT obs_id, cast(coalesce(json_extract_string(payload_json, '$.size'), json_extract_string(payload_json, '$.amount')) AS double) AS amount,
 json_extract_string(payload_json, '$.side') AS side, json_extract_string(payload_json, '$.outcome') AS outcome FROM observations""")
def _(t):
    p = F.col("payload_json")
    return t.observations.select(
        "obs_id", S.payload_amount(p).alias("amount"), F.get_json_object(p, "$.side").alias("side"), F.get_json_object(p, "$.outcome").alias("outcome")
    )


@query("x5_safe_numbers", """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL WHEN event_id % 5 = 3 THEN NULL ELSE price END AS v FROM trades""")
def _(t):
    k = F.col("event_id") % 5
    text = F.when(k == 0, "None").when(k == 1, " NaN ").when(k == 2, "").when(k == 3, "12x").otherwise(F.concat(F.lit(" "), F.col("price").cast("string")))
    return t.trades.select("event_id", S.safe_double(text).alias("v"))


@query("x6_entity_ids", """SELECT wallet, 've_' || substr(sha256(CASE WHEN root_b IS NULL THEN root_a WHEN root_a = root_b THEN root_a ELSE least(root_a, root_b) || '|' || greatest(root_a, root_b) END), 1, 16) AS entity_id FROM funding WHERE nation <> 3
 UNION ALL SELECT wallet, 've_' || substr(sha256('solo:' || wallet), 1, 16) FROM funding WHERE nation = 3""")
def _(t):
    roots = F.when(F.col("nation") != 3, F.array_compact(F.array(F.col("root_a"), "root_b", F.upper("root_a"), F.lit("junk"))))
    return t.funding.select("wallet", S.entity_id(roots, F.col("wallet")).alias("entity_id"))


@query("x7_posterior", """WITH s AS (SELECT execution_id, greatest(1e-6, least(1 - 1e-6, posterior)) AS p, -qty / 8 AS z, ev_net * 40 + 1 AS k FROM executions),
 o AS (SELECT execution_id, p / (1 - p) * CASE WHEN z < -4 THEN 5.0 ELSE 1.0 END * pow(2.0, k) AS od FROM s) SELECT execution_id, round(least(0.99, greatest(1e-6, od / (1 + od))), 6) AS posterior FROM o""")
def _(t):
    e = t.executions
    return e.select("execution_id", F.round(D.posterior(F.col("posterior"), -F.col("qty") / 8, F.col("ev_net") * 40 + 1), 6).alias("posterior"))


@query("x8_consensus_posterior", """WITH s AS (SELECT market_id, least(0.999999, greatest(0.000001, insider_score)) AS sc FROM trades JOIN entities USING (wallet)),
 r AS (SELECT market_id, count(*) AS n, greatest(0.1, least(20.0, exp(sum(ln(sc) - ln(1 - sc)) / (count(*) + 1)))) AS lr FROM s GROUP BY 1)
 SELECT market_id, n, round(lr, 5) AS lr, round(greatest(0.001, least(0.999, lr / (lr + 1))), 5) AS posterior FROM r""")
def _(t):
    s = t.trades.join(t.entities, "wallet")
    r = s.groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), D.mean_log_odds(F.col("insider_score"), F.lit(1)).alias("lr"))
    return r.select("market_id", "n", F.round("lr", 5).alias("lr"), F.round(D.consensus_posterior(F.col("lr")), 5).alias("posterior"))


@query("x9_decisions", """WITH i AS (SELECT execution_id, posterior AS prior, 1 + qty / 25 AS lr, entry_price AS price, 0.01 AS fee, abs(ev_net) / 2 AS slippage,
   CASE WHEN order_no % 3 = 0 THEN NULL ELSE least(0.99, entry_price + 0.02) END AS ask, entry_price - 0.01 AS bid, accepted = 1 AS allow_trade FROM executions),
 p AS (SELECT *, CASE WHEN slippage > 0.02 THEN prior ELSE prior / (1 - prior) * lr / (1 + prior / (1 - prior) * lr) END AS post, coalesce(ask, price) AS e FROM i),
 v AS (SELECT *, CASE WHEN slippage > 0.02 THEN -1.0 ELSE post * (1 - e) - (1 - post) * e - (fee + slippage + CASE WHEN ask IS NOT NULL THEN greatest(0, ask - bid) ELSE 0 END) END AS ev,
   CASE WHEN slippage > 0.02 THEN 0.0 ELSE greatest(0, 0.25 * ((1 - e) / e * post - (1 - post)) / greatest((1 - e) / e, 1e-6)) END AS kelly FROM p)
 SELECT execution_id, round(post, 6) AS posterior, round(ev, 6) + 0.0 AS ev_net, round(kelly, 6) + 0.0 AS kelly, round(kelly * 0.98, 6) + 0.0 AS sized,
   CASE WHEN slippage <= 0.02 AND allow_trade AND ev > 0 AND kelly > 0 THEN 'BUY' ELSE 'HOLD' END AS action FROM v""")
def _(t):
    c = F.col
    df = t.executions.select(
        "execution_id", c("posterior").alias("prior"), (1 + c("qty") / 25).alias("likelihood_ratio"), c("entry_price").alias("price"), F.lit(0.01).alias("fee"),
        (F.abs("ev_net") / 2).alias("slippage"), F.when(c("order_no") % 3 != 0, F.least(F.lit(0.99), c("entry_price") + 0.02)).alias("ask"),
        (c("entry_price") - 0.01).alias("bid"), F.lit(0.25).alias("alpha"), (c("accepted") == 1).alias("allow_trade"),
    )
    d = D.decide(df)
    return d.select(
        "execution_id", F.round("posterior", 6).alias("posterior"), F.round("ev_net", 6).alias("ev_net"), F.round("kelly", 6).alias("kelly"),
        F.round(D.size_after_friction(c("kelly"), 0.01, 0.01), 6).alias("sized"), "action",
    )


GATE_SQL = """g0 AS (SELECT *, CASE WHEN ping_ms > 200 THEN p_prior ELSE least(greatest(least(greatest(p_prior, 1e-6), 1 - 1e-6) * exp(-0.001 * delta_t_ms), 1e-6), 1 - 1e-6) END AS p_adjusted,
   CASE WHEN ping_ms > 200 THEN 0.0 ELSE order_size * kyle_lambda * (1 + 3 * greatest(0, least(1, imbalance))) END AS slip FROM gin),
 g1 AS (SELECT *, quote_price + slip AS p_avg FROM g0),
 g2 AS (SELECT *, CASE WHEN ping_ms > 200 THEN -1.0 ELSE p_adjusted * order_size - capital_in - avg_entry_price * order_size - 0.02 * p_avg * (1 - p_avg) - 0.001 - greatest(0, p_avg - quote_price) END AS ev FROM g1),
 g3 AS (SELECT *, CASE WHEN ping_ms > 200 THEN -1.0 ELSE ev - capital_in * 0.0008 * 3 END AS adj FROM g2),
 g4 AS (SELECT *, CASE WHEN ping_ms > 200 THEN 'NETWORK_LATENCY_BREAKER' WHEN degraded AND adj <= 0 THEN 'DEGRADED_AND_EV_NOT_ENOUGH' WHEN degraded THEN 'L2_TIMEOUT_DEGRADED'
   WHEN slippage_tolerance < 0.01 AND slip > slippage_tolerance THEN 'SLIPPAGE_TOLERANCE_EXCEEDED' WHEN adj <= 0 THEN 'NON_POSITIVE_TIME_ADJUSTED_EV' ELSE 'PASS' END AS gate_reason FROM g3)"""


@query("x10_gate", f"""WITH gin AS (SELECT execution_id, posterior AS p_prior, entry_price AS quote_price, qty AS order_size, entry_price * qty * 0.1 AS capital_in, entry_price / 3 AS avg_entry_price,
   qty * 6 AS delta_t_ms, abs(ev_net) * 20 AS imbalance, CASE WHEN order_no % 3 = 0 THEN 0.005 ELSE 0.05 END AS slippage_tolerance, (order_no % 230)::double AS ping_ms, 0.0001 * (order_no % 9) AS kyle_lambda,
   order_no % 5 = 0 AS degraded FROM executions), {GATE_SQL}
 SELECT execution_id, round(p_adjusted, 6) AS p_adjusted, round(p_avg, 6) AS p_avg, round(slip, 6) AS expected_slippage, round(ev, 5) + 0.0 AS ev_net, round(adj, 5) + 0.0 AS ev_time_adj,
   CASE WHEN ping_ms > 200 THEN 0.0 WHEN degraded THEN 0.1 ELSE 0.25 END::double AS kelly_cap, gate_reason,
   CASE gate_reason WHEN 'PASS' THEN 'EXECUTE' WHEN 'L2_TIMEOUT_DEGRADED' THEN 'DEGRADE' ELSE 'ABORT' END AS decision FROM g4""")
def _(t):
    c = F.col
    df = t.executions.select(
        "execution_id", c("posterior").alias("p_prior"), c("entry_price").alias("quote_price"), F.lit(1.0).alias("payout"), c("qty").alias("order_size"),
        (c("entry_price") * c("qty") * 0.1).alias("capital_in"), (c("entry_price") / 3).alias("avg_entry_price"), (c("qty") * 6).alias("delta_t_ms"),
        F.lit(0.001).alias("gamma"), F.when(c("order_no") % 3 == 0, 0.005).otherwise(0.05).alias("slippage_tolerance"), F.lit(0.0).alias("min_ev"),
        F.lit(0.0008).alias("daily_opp_cost"), F.lit(3.0).alias("days_to_resolution"), (F.abs("ev_net") * 20).alias("imbalance"),
        (c("order_no") % 230).cast("double").alias("ping_ms"), (0.0001 * (c("order_no") % 9)).alias("kyle_lambda"), (c("order_no") % 5 == 0).alias("degraded"),
        F.lit(0.02).alias("base_fee"), F.lit(0.001).alias("gas_cost"), F.lit(0.25).alias("kelly_cap"),
    )
    g = D.gate(df)
    r = lambda n, k: F.round(n, k).alias(n)
    return g.select(
        "execution_id", r("p_adjusted", 6), r("p_avg", 6), r("expected_slippage", 6), r("ev_net", 5), r("ev_time_adj", 5), "kelly_cap", "gate_reason", "decision"
    )


@query("x11_cognitive_scores", """WITH b AS (SELECT event_id, wallet, ts_us // 3600000000 % 24 AS h, ts_us // 60000000 % 60 AS mi, usd > 5 AS pre, price AS sentiment FROM trades),
 f AS (SELECT b.*, nation % 5 IN (0, 1, 2) AS off, CASE WHEN nation % 5 = 0 THEN 'MIXER' WHEN nation % 5 IN (1, 2) THEN 'CEX_HOT_WALLET' ELSE 'NORMAL' END AS funding_risk, insider_score AS g
   FROM b JOIN funding USING (wallet) JOIN entities USING (wallet)),
 s AS (SELECT *, greatest(0, least(1, 0.45 * (h BETWEEN 1 AND 5)::int + 0.35 * CASE WHEN mi % 5 = 0 THEN 1.0 ELSE 0.3 END + 0.2 * pre::int))::double AS beh FROM f),
 u AS (SELECT *, greatest(0, least(1, CASE WHEN off THEN beh * 0.8 ELSE g + beh * 0.4 END)) AS trust FROM s)
 SELECT event_id, funding_risk, round(beh, 6) AS behavior_score, round(trust, 6) AS trust, round(greatest(0, least(1, (trust + sentiment) / 2)), 6) AS signal_reliability,
   round(greatest(0, least(1, sentiment * 0.7 + trust * 0.3)), 6) AS external_event_score FROM u""")
def _(t):
    n = F.col("nation") % 5
    label = F.when(n == 0, "tornado x").when(n == 1, "okx").when(n == 2, "hot wallet").otherwise(F.col("label"))
    df = (
        t.trades.join(t.funding, "wallet").join(t.entities.select("wallet", F.col("insider_score").alias("graph_trust")), "wallet")
        .select("event_id", F.timestamp_micros("ts_us").alias("seen_at"), (F.col("usd") > 5).alias("preflight"), F.col("price").alias("sentiment"), label.alias("funding_label"), "graph_trust")
    )
    r = lambda c: F.round(c, 6).alias(c)
    return S.cognitive_scores(df).select("event_id", "funding_risk", r("behavior_score"), r("trust"), r("signal_reliability"), r("external_event_score"))


@query("x12_lookups", """SELECT position_id, cast(CASE WHEN signed_usd >= 0 THEN 1 ELSE -1 END AS int) AS direction,
 CASE position_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.55 WHEN 2 THEN 0.65 ELSE 0.5 END::double AS label_weight,
 CASE position_id % 4 WHEN 0 THEN '#22d3ee' WHEN 1 THEN '#34d399' ELSE '#94a3b8' END AS color FROM holdings""")
def _(t):
    k = F.col("position_id") % 4
    tag = F.when(k == 0, "ALGO_SLICING").when(k == 1, "LONG_TERM_HOLDER").when(k == 2, "SMART_MONEY_QUANT").otherwise("OTHER")
    quality = F.when(k == 0, "tier1").when(k == 1, "whale").otherwise("??")
    return t.holdings.select(
        "position_id", S.direction(F.col("signed_usd")).alias("direction"), S.label_weight(tag).alias("label_weight"),
        S.lookup(S.QUALITY_COLOR, quality, "#94a3b8").alias("color"),
    )


@query("x13_cluster_merge", """SELECT market_id, CASE WHEN market_no % 3 = 0 THEN 'n' || (market_no % 7) ELSE 'c' || (market_no % 40) END AS cluster_id,
 CASE WHEN market_no % 3 = 0 THEN -1 ELSE 1 END::int AS internal_direction, CASE WHEN market_no % 3 = 0 THEN 2 ELSE 1 END::int AS n_entities FROM markets""")
def _(t):
    m = t.markets
    row = lambda p, k, d, ents, at: m.select(
        "market_id", "market_no", F.concat(F.lit(p), (F.col("market_no") % k).cast("string")).alias("cluster_id"), F.lit(d).alias("internal_direction"), ents.alias("entities"), F.lit(at).cast("long").alias("updated_us")
    )
    old = row("c", 40, 1, F.array("brand"), 5)
    new = row("n", 7, -1, F.array("brand", "tier"), 4).filter("market_no % 3 = 0")
    return S.merge_cluster_rows(old, new).select("market_id", "cluster_id", "internal_direction", F.size("entities").alias("n_entities"))


@query("x14_book_features", """SELECT event_id, round(CASE WHEN bid_size + ask_size = 0 THEN 0 ELSE (bid_size - ask_size) / (bid_size + ask_size) END, 6) + 0.0 AS imbalance,
 round(CASE WHEN ask_size <= 0 THEN 0 ELSE (ask - bid) / ask_size END, 6) AS impact,
 round(-(greatest(bid, 0.001) * log2(greatest(bid, 0.001)) + (1 - greatest(bid, 0.001)) * log2(1 - greatest(bid, 0.001))), 6) AS entropy FROM quotes""")
def _(t):
    c = F.col
    p = F.greatest("bid", F.lit(0.001))
    return t.quotes.select(
        "event_id", F.round(S.size_imbalance(c("bid_size"), c("ask_size")), 6).alias("imbalance"), F.round(S.spread_impact(c("ask") - c("bid"), c("ask_size")), 6).alias("impact"),
        F.round(S.distribution_entropy(F.array(p, 1 - p)), 6).alias("entropy"),
    )
