"""Registered filters and classifiers."""

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.functions import fixed as X
from tapewatch.operators import predicates as P
from tapewatch.operators import scalars as S
from tapewatch.sources.bindings import AS_OF_US, DAY_US, HOUR_US, ORDERS_AS_OF_US, US


def any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("p2_alias_columns", """SELECT event_id, wallet AS taker, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS side_sign, round(abs(size), 2) AS size, market_id AS market, outcome AS outcome_side FROM trades""")
def _(t):
    k = F.col("event_id") % 3
    raw = t.trades.select(
        "event_id",
        F.when(k == 0, F.col("wallet")).alias("taker"), F.when(k == 1, F.col("wallet")).alias("trader"), F.when(k == 2, F.upper("wallet")).alias("x"),
        F.when(k == 2, F.col("wallet")).alias("address"),
        F.when(k == 0, F.lower("side")).when(k == 1, F.concat("side", F.lit("_YES"))).otherwise(F.when(F.col("side") == "BUY", "1").otherwise("-1")).alias("side"),
        F.when(k == 0, (-F.col("size")).cast("string")).when(k == 1, F.lit("n/a")).alias("size"), F.when(k != 0, F.col("size").cast("string")).alias("amount"),
        F.when(k == 0, F.lit(" ")).otherwise(F.col("market_id")).alias("market"), F.col("market_id").alias("token_id"),
        F.when(k == 0, F.lower("outcome")).when(k == 1, F.concat(F.lit("buy_"), "outcome")).alias("outcome_side"), F.when(k == 2, F.col("outcome")).alias("bet"),
    )
    return S.resolve_aliases(raw).select("event_id", "taker", "side_sign", F.round("size", 2).alias("size"), "market", "outcome_side")


@query("p3_unfilled_evidence", "SELECT event_id, status FROM trades WHERE status = 'CANCELLED'")
def _(t):
    return P.unfilled_evidence(t.trades).select("event_id", "status")


@query("p3_filled_only", "SELECT event_id, status FROM trades WHERE status = 'MATCHED'")
def _(t):
    return P.filled_only(t.trades).select("event_id", "status")


@query("p4_quality_gate", """SELECT CASE WHEN event_id % 13 = 0 THEN 'no_wallet' WHEN usd <= 0 THEN 'no_value' WHEN event_id % 7 = 0 THEN 'no_tx_hash' ELSE 'ok' END AS reason, count(*) AS n FROM trades GROUP BY 1""")
def _(t):
    rows = t.trades.withColumn("wallet", F.when(F.col("event_id") % 13 != 0, F.col("wallet"))).withColumn("tx_hash", F.when(F.col("event_id") % 7 != 0, F.col("tx_hash")).otherwise(""))
    return rows.groupBy(F.coalesce(P.reject_reason(), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


LEFT_S = f"(end_us - {AS_OF_US}) / {float(US)}"
FAST_SQL = f"""({any_sql('lower(slug)', X.FAST_MARKET_WORDS)} OR ({any_sql('lower(slug)', ['bitcoin', 'btc'])} AND {any_sql('lower(slug)', ['up', 'down'])})
 OR (contains(lower(question), 'bitcoin') AND {any_sql('lower(question)', ['5 minute', '5-min', '5m'])})) AND volume >= 100 AND {LEFT_S} BETWEEN 60 AND 2100"""
SHORT_SQL = f"""NOT closed AND NOT {any_sql('lower(slug)', X.SHORT_EVENT_EXCLUDED_WORDS)} AND NOT {any_sql('lower(category)', X.SPORTS_CATEGORIES)}
 AND volume >= 500 AND {LEFT_S} / 86400 BETWEEN 3 AND 30 AND best_bid < 0.99 AND best_bid > 0.01"""
RISK_SQL = f"CASE WHEN {any_sql('lower(slug)', X.LOW_RISK_WORDS)} THEN 'LOW' WHEN {any_sql('lower(slug)', X.HIGH_RISK_WORDS)} THEN 'HIGH' ELSE 'MEDIUM' END"


def sports_sql(cats, words, extra):
    bc, bs = any_sql("lower(category)", cats), any_sql("lower(slug)", words)
    return f"({extra} AND ({bc} OR {bs}) AND NOT ({bs} AND NOT {bc} AND {any_sql('lower(slug)', X.SPORTS_GUARD_WORDS)}) AND end_us - {AS_OF_US} <= {45 * DAY_US})"


SPORTS_SQL = sports_sql(X.SPORTS_CATEGORIES, X.SPORTS_SLUG_WORDS, f"NOT {any_sql('lower(slug)', X.SEASON_WORDS)}")
ARB_SQL = sports_sql(X.ARB_SPORTS_CATEGORIES, X.ARB_SPORTS_SLUG_WORDS, "active")


@query("p5_fast_markets", f"SELECT market_id, slug FROM markets WHERE {FAST_SQL}")
def _(t):
    return t.markets.filter(P.fast_market(AS_OF_US)).select("market_id", "slug")


@query("p6_short_event_markets", f"SELECT market_id, slug, {RISK_SQL} AS risk FROM markets WHERE {SHORT_SQL}")
def _(t):
    return t.markets.filter(P.short_event_market(AS_OF_US)).select("market_id", "slug", P.resolution_risk(F.col("slug")).alias("risk"))


@query("p7_sports_markets", f"SELECT market_id, {SPORTS_SQL} AS radar, {ARB_SQL} AS arb FROM markets WHERE {SPORTS_SQL} OR {ARB_SQL}")
def _(t):
    m = t.markets.select("market_id", P.sports_market(AS_OF_US).alias("radar"), P.sports_market(AS_OF_US, "arb").alias("arb"))
    return m.filter("radar or arb")


@query("p8_sports_rejections", f"""WITH r AS (SELECT *, {any_sql('lower(category)', X.SPORTS_CATEGORIES)} AS bc, {any_sql('lower(slug)', X.SPORTS_SLUG_WORDS)} AS bs FROM markets WHERE NOT {SPORTS_SQL}),
 x AS (SELECT CASE WHEN {any_sql('lower(slug)', X.SEASON_WORDS)} THEN 'season_kw' WHEN bs AND NOT bc AND {any_sql('lower(slug)', X.SPORTS_GUARD_WORDS)} THEN 'pol_guard'
   WHEN bs AND NOT bc THEN 'slug_only' WHEN bc THEN 'category_only' END AS reason FROM r
   UNION ALL SELECT CASE WHEN NOT active THEN 'inactive' WHEN end_us - {AS_OF_US} > {45 * DAY_US} THEN 'expiry>45d' END FROM r)
 SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1""")
def _(t):
    r = t.markets.select(F.explode(P.sports_rejections(AS_OF_US)).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


POL_CAT = "CASE " + " ".join(f"WHEN contains(lower(slug), '{w}') THEN '{X.POLITICAL_CATEGORY[w]}'" for w in X.POLITICAL_WORDS if w in X.POLITICAL_CATEGORY) + " ELSE 'OTHER' END"
POL_SQL = f"NOT {any_sql('lower(slug)', X.POLITICAL_EXCLUDED_WORDS)} AND volume >= 5000 AND best_bid < 0.99 AND best_bid > 0.01 AND {any_sql('lower(slug)', X.POLITICAL_WORDS)}"
POL_KW = "array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in X.POLITICAL_WORDS) + "], lambda w: contains(lower(slug), w)), ',')"


@query("p9_political_markets", f"SELECT market_id, slug, {POL_CAT} AS political_category, {POL_KW} AS keywords FROM markets WHERE {POL_SQL}")
def _(t):
    return P.political_markets(t.markets).select("market_id", "slug", "political_category", F.array_join("keywords", ",").alias("keywords"))


@query("p10_tier_classifier", f"""SELECT market_id, CASE WHEN {any_sql('lower(slug)', X.TIER_FAST_WORDS)} AND {LEFT_S} <= 86400 THEN 't1'
 WHEN {any_sql('lower(category)', X.TIER_SPORTS_WORDS)} AND {LEFT_S} <= 172800 THEN 't5'
 WHEN NOT {any_sql('lower(slug)', X.TIER_FAST_WORDS)} AND {LEFT_S} > 172800 THEN 't2' ELSE 't3' END AS tier FROM markets""")
def _(t):
    return t.markets.select("market_id", P.tier_of(AS_OF_US).alias("tier"))


@query("p11_resolution_risk", f"SELECT {RISK_SQL} AS risk, count(*) AS n FROM markets GROUP BY 1")
def _(t):
    return t.markets.groupBy(P.resolution_risk(F.col("slug")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("p12_market_kind", f"""WITH r AS (SELECT DISTINCT market_id FROM trades WHERE ts_us BETWEEN {AS_OF_US - 6 * HOUR_US} AND {AS_OF_US}),
 w AS (SELECT m.market_id, r.market_id IS NOT NULL AS traded, best_ask - best_bid > 0.15 AS wide FROM markets m LEFT JOIN r USING (market_id))
 SELECT market_id, CASE WHEN traded THEN 'CLOB' WHEN wide THEN 'AMM' ELSE 'CLOB_QUIET' END AS kind, traded OR NOT wide AS best_ask_eligible FROM w""")
def _(t):
    return P.market_kind(t.markets, t.trades, AS_OF_US, 6 * HOUR_US, wide_spread=0.15).select("market_id", "kind", "best_ask_eligible")


@query("p13_quote_price", """WITH q AS (SELECT event_id, bid, ask, CASE WHEN event_id % 4 = 0 THEN 0.5 WHEN event_id % 4 = 1 THEN NULL ELSE bid END AS last FROM quotes)
 SELECT event_id, round(CASE WHEN round(ask - bid, 6) <= 0.1 THEN (bid + ask) / 2 WHEN last <> 0.5 THEN last END, 6) AS price FROM q""")
def _(t):
    k = F.col("event_id") % 4
    last = F.when(k == 0, 0.5).when(k == 1, F.lit(None).cast("double")).otherwise(F.col("bid"))
    return t.quotes.select("event_id", F.round(P.quote_price(F.col("bid"), F.col("ask"), last), 6).alias("price"))


@query("p14_time_weight", f"""SELECT market_id, CASE WHEN h < 6 THEN 1.0::double WHEN h < 24 THEN 0.85 WHEN h < 72 THEN 0.65 WHEN h < 168 THEN 0.45 ELSE 0.30 END AS weight
 FROM (SELECT market_id, greatest(0, (end_us - {AS_OF_US}) / {3600.0 * US}) AS h FROM markets)""")
def _(t):
    return t.markets.select("market_id", P.time_weight(F.col("end_us"), AS_OF_US).alias("weight"))


@query("p15_fee_filter", """SELECT DISTINCT 't' || market_no || 'y' AS token_id, cast(fee_bps AS bigint) AS fee_bps FROM markets WHERE coalesce(fee_bps, 0) <= 300""")
def _(t):
    m = t.markets
    tok = F.concat(F.lit("t"), F.col("market_no").cast("string"), F.lit("y")).alias("token_id")
    fees = m.filter("fee_bps is not null").select(tok, F.col("fee_bps").cast("long").alias("fee_bps"))
    return P.fee_filter(m.select(tok), fees)


@query("p16_settlement_price", """WITH l AS (SELECT asset_id, arg_max(price, ts_us) AS last_price FROM trades GROUP BY 1)
 SELECT asset_id, last_price, CASE WHEN last_price >= 0.95 THEN 1.0 WHEN last_price <= 0.05 THEN 0.0 ELSE last_price END AS settlement_price FROM l""")
def _(t):
    return P.settlement_prices(t.trades, "asset_id", ["ts_us", "event_id"])


@query("p17_period_and_status", f"""SELECT '30d' AS period, trade_id, pnl FROM settlements WHERE closed_us >= {ORDERS_AS_OF_US - 120 * DAY_US - 30 * DAY_US} AND pnl > 0
 UNION ALL SELECT 'all', trade_id, pnl FROM settlements WHERE pnl < 0""")
def _(t):
    s = t.settlements
    as_of = ORDERS_AS_OF_US - 120 * DAY_US
    wins = s.filter(P.in_period(F.col("closed_us"), "30d", as_of) & P.outcome_is(F.col("pnl"), "win")).select(F.lit("30d").alias("period"), "trade_id", "pnl")
    losses = s.filter(P.in_period(F.col("closed_us"), "all", as_of) & P.outcome_is(F.col("pnl"), "loss")).select(F.lit("all").alias("period"), "trade_id", "pnl")
    return wins.unionByName(losses)


@query("p18_funding_risk", """WITH l AS (SELECT wallet, CASE WHEN nation % 5 = 0 THEN 'Tornado ' || label WHEN nation % 5 = 1 THEN 'Binance ' || label WHEN nation % 5 = 2 THEN 'my hot wallet' ELSE label END AS lb, nation FROM funding)
 SELECT wallet, CASE WHEN nation % 5 = 0 THEN 'MIXER' WHEN nation % 5 IN (1, 2) THEN 'CEX_HOT_WALLET' ELSE 'NORMAL' END AS risk, nation % 5 IN (0, 1, 2) AS trace_disabled FROM l""")
def _(t):
    n = F.col("nation") % 5
    label = F.when(n == 0, F.concat(F.lit("Tornado "), "label")).when(n == 1, F.concat(F.lit("Binance "), "label")).when(n == 2, "my hot wallet").otherwise(F.col("label"))
    r = t.funding.select("wallet", P.funding_risk(label).alias("risk"))
    return r.withColumn("trace_disabled", F.col("risk") != "NORMAL")


@query("p19_artifact_contract", """SELECT market_id, CASE WHEN market_no % 6 = 0 THEN 'missing_source' WHEN market_no % 6 = 1 THEN 'source_not_allowed' WHEN market_no % 6 = 2 THEN 'source_blocked'
 WHEN market_no % 6 = 3 THEN 'missing_timestamp' WHEN market_no % 6 = 4 THEN 'missing_version' END AS violation FROM markets WHERE market_no % 6 <> 5""")
def _(t):
    k = F.col("market_no") % 6
    rows = t.markets.select(
        "market_id", F.when(k == 0, " ").when(k == 1, "elsewhere").when(k == 2, "Graph_Report x").otherwise("radar").alias("source"),
        F.when(k == 3, "").otherwise("2024-01-01").alias("timestamp"), F.when(k == 4, F.lit(None).cast("string")).otherwise("v1").alias("version"),
    )
    return rows.select("market_id", P.artifact_violation(["radar", "Graph_Report x"]).alias("violation")).filter("violation is not null")


@query("p20_macro_bypass", """SELECT event_id FROM trades WHERE event_type IN ('view', 'click') AND event_id % 2 = 1""")
def _(t):
    src = F.when(F.col("event_type") == "view", "macro_feed").when(F.col("event_type") == "click", "raw list").otherwise("radar")
    return t.trades.filter(P.macro_bypass(src, F.col("event_id") % 2 == 0)).select("event_id")
