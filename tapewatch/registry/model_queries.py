"""Registered series, graph, consensus, risk and information queries."""

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators.lineage import cut_lineage
from tapewatch.operators import consensus as C
from tapewatch.operators import graph as G
from tapewatch.operators import information as I
from tapewatch.operators import risk as RK
from tapewatch.operators import series as SR
from tapewatch.operators.sequence import DAY, HOUR
from tapewatch.registry.join_queries import FUNDED_SQL, SYNC_PAIRS_SQL, SYNC_US, TAKERS_SQL, TEMPORAL_SQL, roots, takers
from tapewatch.registry.micro import FILLS, fills
from tapewatch.registry.predicate_queries import RISK_SQL
from tapewatch.registry.scalar_queries import DEADLINE_SQL, STAMP_SQL

SERIES_SQL = f"""tg AS (SELECT market_id, slug, end_us, best_bid AS prob, {STAMP_SQL} AS w, {DEADLINE_SQL} AS lad, regexp_replace(slug, '-(\\d{{9,11}})$', '') AS rol FROM markets),
 mm AS (SELECT *, CASE WHEN w > 0 THEN rol WHEN lad <> slug THEN lad END AS series_id, CASE WHEN w > 0 THEN 'ROLLING_WINDOW' ELSE 'DEADLINE_LADDER' END AS series_type, CASE WHEN w > 0 THEN w ELSE end_us END AS position FROM tg),
 members AS (SELECT *, count(*) OVER (PARTITION BY series_id, series_type) AS n FROM mm WHERE series_id IS NOT NULL QUALIFY series_type = 'ROLLING_WINDOW' OR n >= 2)"""


@query("g5_series_detection", f"""WITH {SERIES_SQL} SELECT series_id, series_type, count(*) AS members, arg_min(slug, (position, slug)) AS first_slug, arg_max(slug, (position, slug)) AS last_slug,
 CASE WHEN series_type = 'ROLLING_WINDOW' THEN 'LOW' ELSE any_value({RISK_SQL.replace('slug', 'series_id')}) END AS risk FROM members GROUP BY 1, 2""")
def _(t):
    return SR.series_list(SR.series_members(t.markets))


@query("w13_ladder_violations", f"""WITH {SERIES_SQL}, l AS (SELECT series_id, slug, prob, lag(prob) OVER w AS p, lag(slug) OVER w AS earlier_slug FROM members WHERE series_type = 'DEADLINE_LADDER' WINDOW w AS (PARTITION BY series_id ORDER BY end_us, slug))
 SELECT series_id, earlier_slug, slug AS later_slug, round(p - prob, 6) AS gap, 'EARLY_OVERPRICED' AS direction FROM l WHERE p - prob > 0.02""")
def _(t):
    return SR.ladder_violations(SR.series_members(t.markets)).withColumn("gap", F.round("gap", 6))


LAST_SQL = "ls AS (SELECT market_id AS market, price AS value, row_number() OVER (PARTITION BY market_id ORDER BY ts_us DESC, event_id DESC) AS lag_no FROM trades)"
EDGES_SQL = f"""{LAST_SQL}, edges AS (SELECT a.market AS market_a, b.market AS market_b, corr(a.value, b.value) AS rho FROM ls a JOIN ls b ON a.lag_no = b.lag_no AND a.market < b.market GROUP BY 1, 2 HAVING count(*) >= 5 AND abs(corr(a.value, b.value)) >= 0.2)"""


def series(t):
    return I.latest_series(t.trades.withColumnRenamed("market_id", "market"), "market", ["ts_us", "event_id"], "price")


def edges(t):
    return I.correlation_edges(series(t), "market", 0.2)


@query("a21_correlation_edges", f"WITH {EDGES_SQL} SELECT market_a, market_b, round(rho, 6) AS rho FROM edges")
def _(t):
    return edges(t).withColumn("rho", F.round("rho", 6))


@query("j22_series_pairs", f"""WITH {LAST_SQL}, pr AS (SELECT DISTINCT 'm' || (20 * (n // 20)) AS market_a, market AS market_b FROM (SELECT market, cast(substr(market, 2) AS bigint) AS n FROM ls) WHERE n % 20 <> 0)
 SELECT market_a, market_b, count(*) AS n, round(corr(a.value, b.value), 6) AS rho FROM pr JOIN ls a ON a.market = market_a JOIN ls b ON b.market = market_b AND a.lag_no = b.lag_no GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(t):
    n = F.substring("market", 2, 20).cast("long")
    s = series(t)
    pairs = t.trades.select(F.col("market_id").alias("market")).distinct().filter(n % 20 != 0).select(
        F.concat(F.lit("m"), (F.floor(n / 20) * 20).cast("string")).alias("market_a"), F.col("market").alias("market_b")
    )
    return I.paired_correlations(s, "market", pairs).withColumn("rho", F.round("rho", 6))


@query("a22_max_rho", f"""WITH {EDGES_SQL}, e AS (SELECT market_a AS market_id, market_b AS peer, rho FROM edges UNION ALL SELECT market_b, market_a, rho FROM edges)
 SELECT market_id, round(max(abs(rho)), 6) AS max_rho FROM e WHERE cast(substr(market_id, 2) AS bigint) // 20 = cast(substr(peer, 2) AS bigint) // 20 GROUP BY 1""")
def _(t):
    once = cut_lineage(edges(t))  # read twice below
    e = RK.both_ways(once)
    grp = lambda c: F.floor(F.substring(c, 2, 20).cast("long") / 20)
    peers = e.filter(grp("market_a") == grp("market_b")).select(F.col("market_a").alias("market_id"), F.col("market_b").alias("peer"))
    return RK.max_abs_rho(once, peers).withColumn("max_rho", F.round("max_rho", 6))


TE_KEY = "market_id, lead, w"
TE_SPAN = 31 * DAY


def te_bin(v):
    return f"CASE WHEN max({v}) OVER g > min({v}) OVER g THEN least(floor(({v} - min({v}) OVER g) / (max({v}) OVER g - min({v}) OVER g) * bins + 1e-9), bins - 1) ELSE 0 END"


def h_sql(cols, name):
    return f"{name} AS (SELECT {TE_KEY}, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS {name} FROM (SELECT {TE_KEY}, count(*) AS c FROM bb GROUP BY {TE_KEY}, {cols}) GROUP BY ALL)"


@query("a23_transfer_entropy", f"""WITH y AS (SELECT market_id, ts_us // {TE_SPAN} AS w, price AS y, row_number() OVER (PARTITION BY market_id, ts_us // {TE_SPAN} ORDER BY ts_us DESC, event_id DESC) AS back, cast(substr(market_id, 2) AS bigint) // 20 AS c FROM trades),
 x AS (SELECT substr(coin, 1, 3) AS lead, cast(substr(coin, 4) AS bigint) AS c, ts_us // {TE_SPAN} AS w, price AS x, row_number() OVER (PARTITION BY coin, ts_us // {TE_SPAN} ORDER BY ts_us DESC, event_id DESC) AS back FROM lead_trades),
 p AS (SELECT market_id, lead, y.w, -y.back AS idx, x, y FROM y JOIN x ON x.c = y.c AND x.w = y.w AND x.back = y.back), rw AS (SELECT a.market_id, a.lead, a.w, b.y AS yt, a.y AS yl, a.x AS xl FROM p a JOIN p b ON a.market_id = b.market_id AND a.lead = b.lead AND a.w = b.w AND b.idx = a.idx + 1),
 nn AS (SELECT {TE_KEY}, count(*) AS n, least(10, greatest(3, floor(sqrt(count(*))))) AS bins FROM p GROUP BY ALL HAVING count(*) >= 50),
 bb AS (SELECT {TE_KEY}, {te_bin('yt')} AS yt, {te_bin('yl')} AS yl, {te_bin('xl')} AS xl FROM rw JOIN nn USING ({TE_KEY}) WINDOW g AS (PARTITION BY {TE_KEY})),
 {h_sql('yt, yl', 'h1')}, {h_sql('yl', 'h2')}, {h_sql('yt, yl, xl', 'h3')}, {h_sql('yl, xl', 'h4')}
 SELECT market_id, lead, w, n, round(greatest(0.0, (h1 - h2) - (h3 - h4)), 5) AS transfer_entropy FROM nn JOIN h1 USING ({TE_KEY}) JOIN h2 USING ({TE_KEY}) JOIN h3 USING ({TE_KEY}) JOIN h4 USING ({TE_KEY})""")
def _(t):
    w = F.floor(F.col("ts_us") / TE_SPAN).alias("w")
    grp = F.floor(F.substring("market_id", 2, 20).cast("long") / 20)
    y = I.numbered_back(t.trades.select("market_id", w, grp.alias("c"), F.col("price").alias("y"), "ts_us", "event_id"), ["market_id", "w"], ["ts_us", "event_id"], "ts_us", DAY)
    lead = t.lead_trades.select(F.substring("coin", 1, 3).alias("lead"), F.substring("coin", 4, 20).cast("long").alias("c"), w, F.col("price").alias("x"), "ts_us", "event_id")
    x = I.numbered_back(lead, ["lead", "c", "w"], ["ts_us", "event_id"], "ts_us", DAY)
    pairs = y.select("market_id", "w", "c", "back", "y").join(x.select("lead", "c", "w", "back", "x"), ["c", "w", "back"]).select("market_id", "lead", "w", (-F.col("back")).alias("idx"), "x", "y")
    te = I.transfer_entropy(pairs, ["market_id", "lead", "w"])
    return te.select("market_id", "lead", "w", "n", F.round("transfer_entropy", 5).alias("transfer_entropy"))


CLUSTER_SQL = "cl AS (SELECT market_id, 'c' || (market_no % 40) AS cluster_id, CASE WHEN market_no % 3 = 0 THEN -1 ELSE 1 END AS dir FROM markets WHERE market_no % 10 <> 9), an AS (SELECT cluster_id, min(market_id) AS anchor FROM cl WHERE cluster_id NOT IN ('c1', 'c2') GROUP BY 1)"


def cluster_dim(t):
    m = t.markets.filter("market_no % 10 <> 9")
    return m.select("market_id", F.concat(F.lit("c"), (F.col("market_no") % 40).cast("string")).alias("cluster_id"), F.when(F.col("market_no") % 3 == 0, -1).otherwise(1).alias("internal_direction"))


EXPO_EDGES_SQL = "ee AS (SELECT 'm' || market_no AS market_a, 'm' || (market_no + 40) AS market_b, cast(market_no % 19 - 9 AS double) / 10 AS rho FROM markets)"


@query("a24_exposure_verdicts", f"""WITH {CLUSTER_SQL}, {EXPO_EDGES_SQL}, e2 AS (SELECT market_a, market_b, rho FROM ee UNION ALL SELECT market_b, market_a, rho FROM ee),
 prop AS (SELECT trade_id AS proposal_id, market_id, CASE WHEN direction = 'YES' THEN position_usd ELSE -position_usd END AS usd FROM settlements),
 ps AS (SELECT market_id, sum(signed_usd) AS s FROM holdings GROUP BY 1),
 pr AS (SELECT p.*, cl.cluster_id, dir, anchor, coalesce(ps.s, 0) AS held FROM prop p LEFT JOIN cl USING (market_id) LEFT JOIN an USING (cluster_id) LEFT JOIN ps USING (market_id)),
 terms AS (SELECT pr.proposal_id, q.s * CASE WHEN q.market_id = coalesce(anchor, q.market_id) THEN 1.0 WHEN e.rho IS NOT NULL THEN e.rho WHEN anchor = pr.market_id THEN CASE WHEN (q.s >= 0) = (pr.dir = 1) THEN 1.0 ELSE -1.0 END ELSE 1.0 END AS term
   FROM pr JOIN cl c2 ON c2.cluster_id = pr.cluster_id JOIN ps q ON q.market_id = c2.market_id LEFT JOIN e2 e ON e.market_a = q.market_id AND e.market_b = anchor),
 nb AS (SELECT proposal_id, sum(term) AS b FROM terms GROUP BY 1),
 v AS (SELECT pr.*, coalesce(b, 0) AS b, coalesce(b, 0) + usd * CASE WHEN anchor IS NULL OR anchor = pr.market_id THEN 1.0 ELSE coalesce(e.rho, 1.0) END AS a FROM pr LEFT JOIN nb USING (proposal_id) LEFT JOIN e2 e ON e.market_a = pr.market_id AND e.market_b = pr.anchor)
 SELECT proposal_id, coalesce(cluster_id, 'UNKNOWN_CLUSTER') AS cluster_id, CASE WHEN cluster_id IS NULL AND abs(held + usd) > 2500 + 1e-9 THEN 'UNKNOWN_CLUSTER_5PCT_CAP' WHEN cluster_id IS NULL THEN 'OK' WHEN abs(a) < abs(b) - 1e-12 THEN 'HEDGE_REDUCES_ABS_NET_DELTA' WHEN abs(a) > 12500 + 1e-9 THEN 'CLUSTER_EXPOSURE_CAP' ELSE 'OK' END AS reason,
  CASE WHEN cluster_id IS NOT NULL THEN round(b, 6) + 0.0 END AS net_before, CASE WHEN cluster_id IS NOT NULL THEN round(a, 6) + 0.0 END AS net_after FROM v""")
def _(t):
    cl = cluster_dim(t)
    anchors = cl.filter("cluster_id not in ('c1', 'c2')").groupBy("cluster_id").agg(F.min("market_id").alias("anchor"))
    m = F.col("market_no")
    e = t.markets.select(F.concat(F.lit("m"), m.cast("string")).alias("market_a"), F.concat(F.lit("m"), (m + 40).cast("string")).alias("market_b"), ((m % 19 - 9).cast("double") / 10).alias("rho"))
    prop = t.settlements.select(F.col("trade_id").alias("proposal_id"), "market_id", F.when(F.col("direction") == "YES", F.col("position_usd")).otherwise(-F.col("position_usd")).alias("proposed_usd"))
    v = RK.exposure_verdicts(prop, t.holdings, cl, anchors, e, 50000.0)
    known = F.col("cluster_id") != "UNKNOWN_CLUSTER"
    return v.select("proposal_id", "cluster_id", "reason", F.when(known, F.round("net_before", 6)).alias("net_before"), F.when(known, F.round("net_after", 6)).alias("net_after"))


@query("a25_largest_cluster", f"WITH {CLUSTER_SQL} SELECT cluster_id, round(sum(signed_usd), 2) AS net_usd FROM holdings h JOIN cl USING (market_id) GROUP BY 1 ORDER BY abs(sum(signed_usd)) DESC LIMIT 1".replace("holdings h", "(SELECT market_id, signed_usd FROM holdings) h"))
def _(t):
    return RK.largest_cluster(t.holdings.select("market_id", "signed_usd"), cluster_dim(t)).withColumn("net_usd", F.round("net_usd", 2))


@query("a26_shared_kelly", """WITH u AS (SELECT cluster_id, sum(kelly) / 200 AS used FROM holdings WHERE cluster_id IS NOT NULL GROUP BY 1), p AS (SELECT trade_id, 'c' || (trade_id % 50) AS cluster_id, entry_price / 2 AS kelly, CASE WHEN trade_id % 3 = 0 THEN NULL ELSE cast(trade_id % 10 AS double) / 10 END AS rho FROM settlements)
 SELECT trade_id, round(CASE WHEN used IS NULL OR coalesce(rho, 0.95) < 0.85 THEN kelly ELSE least(kelly, greatest(0, 0.25 - used) / 2) END, 6) AS kelly_shared FROM p LEFT JOIN u USING (cluster_id)""")
def _(t):
    inv = t.holdings.filter("cluster_id is not null").select("cluster_id", (F.col("kelly") / 200).alias("kelly"))
    k = F.col("trade_id")
    prop = t.settlements.select("trade_id", F.concat(F.lit("c"), (k % 50).cast("string")).alias("cluster_id"), (F.col("entry_price") / 2).alias("kelly"), F.when(k % 3 != 0, (k % 10).cast("double") / 10).alias("rho"))
    return RK.shared_kelly(prop, inv).select("trade_id", F.round("kelly_shared", 6).alias("kelly_shared"))


@query("a28_committee", "SELECT market_id, round(avg(posterior), 6) AS committee_score, round(max(posterior) - min(posterior), 6) AS disagreement FROM executions GROUP BY 1")
def _(t):
    c = RK.committee(t.executions.select("market_id", F.col("posterior").alias("score")), "market_id")
    return c.select("market_id", F.round("committee_score", 6).alias("committee_score"), F.round("disagreement", 6).alias("disagreement"))


def reach(edge_cte, name="reach"):
    return f"""{name}(a, b) AS (SELECT a, b FROM {edge_cte} UNION SELECT r.a, e.b FROM {name} r JOIN {edge_cte} e ON r.b = e.a)"""


G1_SQL = f"""{TAKERS_SQL.replace(str(DAY), str(DAY))}, {TEMPORAL_SQL}, {FUNDED_SQL}, ed AS (SELECT wallet_a, wallet_b, max(weight) AS weight FROM (SELECT wallet_a, wallet_b, weight FROM temporal UNION ALL SELECT wallet_a, wallet_b, weight FROM funded) GROUP BY 1, 2),
 sy AS (SELECT wallet_a AS a, wallet_b AS b FROM ed UNION SELECT wallet_b, wallet_a FROM ed), {reach('sy')}, comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
 cw AS (SELECT component, avg(weight) AS avg_weight, count(*) AS edges FROM ed JOIN comp ON node = wallet_a GROUP BY 1), cs AS (SELECT component, count(*) AS size,
  concat_ws('|', min(node), count(*), sum(('0x' || substr(md5(node), 1, 15))::BIGINT), bit_xor(('0x' || substr(md5(node), 16, 15))::BIGINT)) AS m FROM comp GROUP BY 1)"""


@query("g1_shock_clusters", f"""WITH RECURSIVE {G1_SQL} SELECT 've_hft_' || substr(sha256(m), 1, 16) AS entity_id, size, edges, round(avg_weight, 6) AS avg_weight, round(least(95, 30 + avg_weight * 65), 4) AS trust_score FROM cw JOIN cs USING (component) WHERE avg_weight >= 0.5 OR (size >= 3 AND avg_weight >= 0.3)""")
def _(t):
    k, _members = G.shock_clusters(takers(t), roots(t), 2 * HOUR)
    return k.select("entity_id", "size", "edges", F.round("avg_weight", 6).alias("avg_weight"), F.round("trust_score", 4).alias("trust_score"))


ENTITY_OF = "substr(sha256(CASE WHEN root_b IS NULL THEN root_a ELSE least(root_a, root_b) || '|' || greatest(root_a, root_b) END), 1, 16)"


@query("g2_sybil_groups", f"""WITH RECURSIVE {SYNC_PAIRS_SQL}, ow AS (SELECT DISTINCT wallet, 've_' || {ENTITY_OF} AS entity FROM funding JOIN trades USING (wallet)),
 sy AS (SELECT wallet AS a, entity AS b FROM ow UNION SELECT entity, wallet FROM ow UNION SELECT wallet_a, wallet_b FROM synced UNION SELECT wallet_b, wallet_a FROM synced), {reach('sy')},
 comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a), g AS (SELECT component, count(*) AS size, arg_min(entity, wallet) AS entity_id FROM comp JOIN ow ON node = wallet GROUP BY 1)
 SELECT node AS wallet, entity_id, size FROM comp JOIN ow ON node = wallet JOIN g USING (component)""")
def _(t):
    w = roots(t).join(t.trades.select("wallet").distinct(), "wallet", "left_semi")
    return G.sybil_groups(w, t.trades, SYNC_US, 0.06)


EFF_SQL = f"""{FILLS}, tr AS (SELECT market_id || '|' || outcome AS mk, wallet, ts_us FROM fills), sy AS (SELECT DISTINCT x.mk || '|' || x.wallet AS a, y.mk || '|' || y.wallet AS b FROM tr x JOIN tr y ON x.mk = y.mk AND abs(x.ts_us - y.ts_us) <= {HOUR}),
 {reach('sy')}, comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a), eff AS (SELECT split_part(node, '|', 1) AS market_id, split_part(node, '|', 2) AS outcome, count(DISTINCT component) AS effective_wallets, count(*) AS wallets FROM comp GROUP BY 1, 2)"""


@query("g3_effective_wallets", f"WITH RECURSIVE {EFF_SQL} SELECT * FROM eff")
def _(t):
    return G.effective_wallets(fills(t), ["market_id", "outcome"], HOUR)


@query("a20_consensus_clusters", f"""WITH RECURSIVE {EFF_SQL}, b AS (SELECT market_id, outcome, count(*) AS n, exp(-1e-7 * (max(ts_us) - min(ts_us)) / 1e6) AS w_time, sum(usd) AS total_usd FROM fills GROUP BY 1, 2 HAVING count(*) >= 2),
 s AS (SELECT market_id, sum(CASE WHEN outcome = 'YES' THEN total_usd ELSE 0 END) AS y, sum(CASE WHEN outcome = 'NO' THEN total_usd ELSE 0 END) AS no FROM b GROUP BY 1),
 j AS (SELECT b.*, effective_wallets, CASE WHEN b.outcome = 'YES' THEN no ELSE y END / greatest(abs(y - no), 20) AS conflict, greatest(200, coalesce(m.volume, 0) * 0.02) AS thr FROM b JOIN s USING (market_id) JOIN eff USING (market_id, outcome) LEFT JOIN markets m USING (market_id)),
 k AS (SELECT *, CASE WHEN total_usd < thr THEN 'below_notional_threshold' WHEN effective_wallets < 3 THEN 'below_wallet_count' END AS reject, effective_wallets * w_time * CASE WHEN conflict > 1.2 THEN 0.25 ELSE 1 END AS k_eff FROM j)
 SELECT market_id, outcome, round(total_usd, 4) AS total_usd, effective_wallets, round(w_time, 6) AS w_time, round(conflict, 6) AS conflict, reject, round(k_eff, 5) AS k_eff, reject IS NULL AND k_eff = (SELECT max(k_eff) FROM k WHERE reject IS NULL) AS is_best FROM k""")
def _(t):
    c = C.consensus_clusters(
        fills(t), t.markets.select("market_id", F.col("volume").alias("ref_usd")), 1e-7, HOUR, 3, 200.0, 0.02, 1.2, "penalize", 0.25, 20.0
    )
    r = lambda n, k: F.round(n, k).alias(n)
    return c.select("market_id", "outcome", r("total_usd", 4), "effective_wallets", r("w_time", 6), r("conflict", 6), "reject", r("k_eff", 5), "is_best")


def tracked(t):
    return t.entities.select("wallet", "entity_id", F.col("trust_score").alias("pnl"), F.lit("tier1").alias("quality"))


TOP_SQL = "top AS (SELECT wallet, entity_id, trust_score AS pnl FROM entities)"


@query("g4_wallet_graph_nodes", f"WITH {TOP_SQL} SELECT wallet, substr(wallet, 1, 6) || '...' || right(wallet, 4) AS label, entity_id, pnl, '#22d3ee' AS color, greatest(1.0, abs(pnl) / 100) AS node_size FROM top")
def _(t):
    o = t.observations.filter("obs_type = 'clob_trade'").select(F.col("address").alias("wallet"), "market_id")
    return G.wallet_graph(tracked(t), o)[0]


@query("g4_wallet_graph_edges", f"""WITH {TOP_SQL}, h AS (SELECT DISTINCT address AS wallet, market_id FROM observations WHERE obs_type = 'clob_trade' AND address IN (SELECT wallet FROM top)),
 sh AS (SELECT a.wallet AS wallet_a, b.wallet AS wallet_b, 'SHARED_MARKET' AS relation, count(*) AS weight FROM h a JOIN h b ON a.market_id = b.market_id AND a.wallet < b.wallet GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT * FROM sh UNION ALL SELECT a.wallet, b.wallet, 'SAME_ENTITY', 99 FROM top a JOIN top b ON a.entity_id = b.entity_id AND a.wallet < b.wallet WHERE NOT EXISTS (SELECT 1 FROM sh WHERE wallet_a = a.wallet AND wallet_b = b.wallet)""")
def _(t):
    o = t.observations.filter("obs_type = 'clob_trade'").select(F.col("address").alias("wallet"), "market_id")
    return G.wallet_graph(tracked(t), o)[1]
