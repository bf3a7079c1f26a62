"""Registered end-to-end plans."""

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators import joins as J
from tapewatch.operators import sequence as Q
from tapewatch.operators.lineage import cut_lineage
from tapewatch.operators.sequence import DAY
from tapewatch.plans.discovery import discovery_cycle
from tapewatch.plans.signals import signal_decisions
from tapewatch.registry.join_queries import MEMBERS_SQL, SCORES_SQL, SYNC_US, rolling_members, roots, scores
from tapewatch.registry.micro import ZSCORE_SQL, zscores
from tapewatch.registry.model_queries import ENTITY_OF, reach
from tapewatch.registry.wallet_queries import WALLET_PNL_SQL, wallet_pnl

XSIG_SQL = f"""{ZSCORE_SQL}, {SCORES_SQL}, {MEMBERS_SQL},
 sg AS (SELECT event_id AS signal_id, z.market_id, tier, round(z, 6) AS z, wallet, asset_id, ts_us AS signal_us, end_us, event_id % 5 = 0 AS te FROM zs z JOIN markets m ON m.market_id = z.market_id WHERE z.z IS NOT NULL),
 bk AS (SELECT asset_id, ts_us, bid, ask FROM quotes), s2 AS (SELECT sg.*, bid, ask FROM sg ASOF LEFT JOIN bk ON sg.asset_id = bk.asset_id AND sg.signal_us >= bk.ts_us),
 st AS (SELECT *, CASE WHEN signal_id % 4 = 0 THEN 0.5 ELSE round(bid + 0.03, 4) END AS last_price FROM s2 WHERE abs(z) >= 0.8),
 wd AS (SELECT st.signal_id, st.signal_us, coalesce(sib.market_id, st.market_id) AS src FROM st LEFT JOIN members m ON m.market_id = st.market_id LEFT JOIN members sib ON sib.series_id = m.series_id),
 so AS (SELECT DISTINCT signal_id, o.address AS wallet, score FROM wd JOIN observations o ON o.market_id = wd.src AND o.ts_us BETWEEN wd.signal_us - {DAY} AND wd.signal_us JOIN scores c ON c.wallet = o.address WHERE score >= 0.55 AND o.address <> '0x0000000000000000000000000000000000000000'),
 gr AS (SELECT signal_id, count(*) AS n, sum(ln(score) - ln(1 - score)) AS lo FROM so GROUP BY 1),
 ps AS (SELECT wallet, market_id, avg(price) AS prev_entry FROM trades WHERE side = 'BUY' GROUP BY 1, 2),
 a AS (SELECT st.*, coalesce(n, 0) AS n_sources, coalesce(n, 0) + te::int AS nn, coalesce(lo, 0) AS lo, prev_entry, CASE WHEN round(ask - bid, 6) <= 0.1 THEN (bid + ask) / 2 WHEN last_price <> 0.5 THEN last_price END AS q FROM st LEFT JOIN gr USING (signal_id) LEFT JOIN ps USING (wallet, market_id)),
 b AS (SELECT *, CASE WHEN nn > 0 THEN greatest(0.1, least(20.0, exp(lo / nn))) END AS lr FROM a),
 c AS (SELECT *, coalesce(greatest(0.001, least(0.999, lr / (lr + 1))), 0.5) AS cons, CASE WHEN end_us <= signal_us THEN 0.30 ELSE CASE WHEN (end_us - signal_us) / 3.6e9 < 6 THEN 1.0 WHEN (end_us - signal_us) / 3.6e9 < 24 THEN 0.85 WHEN (end_us - signal_us) / 3.6e9 < 72 THEN 0.65 WHEN (end_us - signal_us) / 3.6e9 < 168 THEN 0.45 ELSE 0.30 END END AS wt,
   CASE WHEN tier = 't1' THEN 'T1_SHORT_CIRCUIT' WHEN nn < 2 THEN 'INSUFFICIENT_CONSENSUS' WHEN q IS NULL OR ask IS NULL THEN 'NO_PRICE_DATA' END AS early FROM b),
 d AS (SELECT *, least(greatest(least(greatest(CASE WHEN tier = 't5' THEN 0.5 * wt ELSE cons END, 1e-6), 1 - 1e-6) * exp(-0.15), 1e-6), 1 - 1e-6) AS padj, CASE WHEN tier = 't5' THEN 0.5 * wt ELSE cons END AS prior, q + 10 * 0.00001 AS pavg FROM c),
 e AS (SELECT *, padj * 10 - q * 10 * 0.05 - ask * 10 - 0.0015 * pavg * (1 - pavg) - (pavg - q) AS ev FROM d),
 f AS (SELECT *, CASE WHEN ev - q * 10 * 0.05 * 0.0008 * 3 <= 0 THEN 'NON_POSITIVE_TIME_ADJUSTED_EV' ELSE 'PASS' END AS g FROM e)"""


@query("xsig_signal_decisions", f"""WITH {XSIG_SQL} SELECT signal_id, market_id, tier, n_sources, (early IS NULL AND g = 'PASS')::int AS accepted, coalesce(early, g) AS reason, round(CASE WHEN early IS NULL THEN prior WHEN early = 'NO_PRICE_DATA' THEN cons ELSE 0 END, 5) AS posterior,
 round(CASE WHEN early IS NULL THEN padj ELSE 0 END, 5) AS p_adj, round(CASE WHEN early IS NULL THEN ev ELSE 0 END, 4) + 0.0 AS ev_net, round(CASE WHEN early IS NULL THEN ask WHEN early = 'NO_PRICE_DATA' THEN coalesce(prev_entry, 0) ELSE 0 END, 5) AS avg_entry_price FROM f""")
def _(t):
    z = zscores(t).filter("z is not null").select(F.col("event_id").alias("signal_id"), "market_id", F.round("z", 6).alias("z"), "wallet", "asset_id", F.col("ts_us").alias("signal_us"))
    # Written, as the as-of join reads its rows twice and z-scores are long chains.
    sig = cut_lineage(z.filter(F.abs("z") >= 0.8).join(t.markets.select("market_id", "tier", "end_us"), "market_id"))
    priced = Q.as_of(sig, t.quotes, "asset_id", "signal_us", "ts_us", ["bid", "ask"], "signal_id", 2 * DAY)
    priced = cut_lineage(
        priced.withColumn("last_price", F.when(F.col("signal_id") % 4 == 0, 0.5).otherwise(F.round(F.col("bid") + 0.03, 4))).withColumn("te_significant", F.col("signal_id") % 5 == 0)
    )
    src = J.consensus_totals(priced.select("signal_id", "market_id", "signal_us"), t.observations, scores(t), rolling_members(t), DAY)
    held = t.trades.filter("side = 'BUY'").groupBy("wallet", "market_id").agg(F.avg("price").alias("avg_entry_price"))
    # A paper stake of a twentieth of the notional keeps some signals profitable on these views.
    out = signal_decisions(priced, src, held, 0.8, 2, 10.0, {"capital_share": 0.05})
    r = lambda n, k: F.round(n, k).alias(n)
    return out.select("signal_id", "market_id", "tier", "n_sources", "accepted", "reason", r("posterior", 5), r("p_adj", 5), r("ev_net", 4), r("avg_entry_price", 5))


A32_SQL = f"""{WALLET_PNL_SQL}, ta AS (SELECT wallet, sum((price - 0.5) * size) AS pnl, avg(price) AS win_rate, 0 AS track FROM trades WHERE outcome = 'YES' GROUP BY 1), tb AS (SELECT wallet, max(pnl) AS pnl, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, 1 AS track FROM wp GROUP BY 1),
 cand AS (SELECT * FROM ta UNION ALL SELECT * FROM tb WHERE wallet NOT IN (SELECT wallet FROM ta)),
 h AS (SELECT wallet, side, usd, ts_us FROM trades WHERE usd > 0), hs AS (SELECT wallet, count(*) AS sample_size, abs(sum(CASE WHEN side = 'BUY' THEN usd ELSE -usd END)) / sum(usd) AS idi FROM h GROUP BY 1),
 surv AS (SELECT c.wallet, c.win_rate, coalesce(sample_size, 0) AS sample_size FROM cand c LEFT JOIN hs USING (wallet) WHERE sample_size IS NULL OR idi >= 0.1),
 st AS (SELECT DISTINCT h.wallet, ts_us, (SELECT count(DISTINCT ts_us) FROM h x WHERE x.wallet = h.wallet) AS n FROM h JOIN surv USING (wallet)),
 hit AS (SELECT a.wallet AS wa, b.wallet AS wb, any_value(a.n) AS n, count(DISTINCT a.ts_us) AS hits FROM st a JOIN st b ON a.wallet <> b.wallet AND b.ts_us BETWEEN a.ts_us - {SYNC_US} AND a.ts_us + {SYNC_US} GROUP BY 1, 2), sync AS (SELECT wa, wb FROM hit WHERE hits / n >= 0.07),
 ow AS (SELECT wallet, 've_' || {ENTITY_OF} AS entity, win_rate, sample_size FROM surv JOIN funding USING (wallet)),
 sy AS (SELECT wallet AS a, entity AS b FROM ow UNION SELECT entity, wallet FROM ow UNION SELECT wa, wb FROM sync UNION SELECT wb, wa FROM sync), {reach('sy')},
 comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a), g AS (SELECT component, count(*) AS wallets, avg(win_rate) AS wr, sum(sample_size) AS n, arg_min(entity, wallet) AS entity_id FROM comp JOIN ow ON node = wallet GROUP BY 1),
 tr AS (SELECT *, CASE WHEN wr >= 0.7 THEN 'ALGO_SLICING' ELSE 'LONG_TERM_HOLDER' END AS tag FROM g)"""


def cycle(t):
    a = t.trades.filter("outcome = 'YES'").groupBy("wallet").agg(F.sum((F.col("price") - 0.5) * F.col("size")).alias("pnl"), F.avg("price").alias("win_rate"), F.lit("CLOB_TAKER").alias("discovery_source"))
    b = wallet_pnl(t).groupBy("wallet").agg(F.max("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.lit("LEADERBOARD").alias("discovery_source"))
    hist = t.trades.filter("usd > 0").select("wallet", "side", "usd", F.lit(0.0).alias("balance_before"), "ts_us", F.lit("observation").alias("source"))
    prev = t.entities.limit(0).select("entity_id", "trust_score")
    return discovery_cycle(a, b, hist, roots(t), prev, SYNC_US, 0.07, 0.1)


@query("a32_discovery_entities", f"""WITH RECURSIVE {A32_SQL} SELECT entity_id, wallets, round(wr, 6) AS avg_win_rate, cast(n AS bigint) AS sample_size, tag AS primary_tag,
 round(greatest(0, least(1, (1 - least(1, n / 100)) * 0.5 + least(1, n / 100) * (wr * 0.7 + CASE tag WHEN 'ALGO_SLICING' THEN 0.75 ELSE 0.55 END * 0.3))) * 100, 1) AS trust_score FROM tr""")
def _(t):
    e = cycle(t)[0]
    return e.select("entity_id", "wallets", F.round("avg_win_rate", 6).alias("avg_win_rate"), "sample_size", "primary_tag", F.round("trust_score", 1).alias("trust_score"))


@query("a32_discovery_summary", f"""WITH RECURSIVE {A32_SQL} SELECT (SELECT count(*) FROM cand) AS fetched_candidates, (SELECT count(*) FROM cand) - (SELECT count(*) FROM surv) AS dropped, (SELECT count(*) FROM ow) AS survivors, 0::bigint AS hybrid, (SELECT count(*) FROM tr) AS entities""")
def _(t):
    return cycle(t)[2]
