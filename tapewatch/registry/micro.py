"""Registered trade-tape queries."""

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators import microstructure as M
from tapewatch.operators.sequence import DAY, HOUR
from tapewatch.sources.bindings import AS_OF_US

FILLS = "fills AS (SELECT * FROM trades WHERE status NOT IN ('OPEN','PENDING','PLACED','ORDER_PLACED','CANCELLED','CANCELED'))"


def fills(t):
    from tapewatch.operators.predicates import filled_only

    return filled_only(t.trades)


SWEEPS_SQL = f"""{FILLS},
step AS (SELECT *, CASE WHEN lag(wallet) OVER w = wallet AND lag(side) OVER w = side
   AND ts_us - lag(ts_us) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS s FROM fills
   WINDOW w AS (PARTITION BY market_id ORDER BY ts_us, event_id)),
isl AS (SELECT *, sum(s) OVER (PARTITION BY market_id ORDER BY ts_us, event_id) AS g FROM step),
sweeps AS (SELECT market_id, any_value(wallet) AS wallet, any_value(side) AS side, sum(size) AS volume,
   min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS child_count, arg_min(event_id, ts_us) AS first_event
   FROM isl GROUP BY market_id, g)"""


def sweeps(t):
    return M.taker_sweeps(fills(t), gap_us=12 * HOUR)


@query("w1_taker_sweeps", f"WITH {SWEEPS_SQL} SELECT market_id, wallet, side, round(volume, 2) AS volume, first_us, last_us, child_count FROM sweeps")
def _(t):
    return sweeps(t).select(
        "market_id", "wallet", "side", F.round("volume", 2).alias("volume"), "first_us", "last_us", "child_count"
    )


BURSTS_SQL = f"""{FILLS},
step AS (SELECT *, CASE WHEN lag(side) OVER w = side AND ts_us - lag(ts_us) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS s FROM fills
   WINDOW w AS (PARTITION BY market_id ORDER BY ts_us, event_id)),
isl AS (SELECT *, sum(s) OVER (PARTITION BY market_id ORDER BY ts_us, event_id) AS g FROM step),
bursts AS (SELECT market_id, any_value(side) AS side, sum(size) AS volume, min(ts_us) AS first_us, max(ts_us) AS last_us,
   count(*) AS trade_count, count(DISTINCT wallet) AS members FROM isl GROUP BY market_id, g
   HAVING count(*) >= 3 AND count(DISTINCT wallet) >= 3)"""


@query("w2_cross_wallet_bursts", f"""WITH {BURSTS_SQL} SELECT market_id, side, round(volume, 2) AS volume, first_us, last_us,
 trade_count, members, CASE WHEN volume > 0 THEN 'COORDINATED_SMURF' ELSE 'UNCERTAIN_NOISE' END AS label FROM bursts""")
def _(t):
    b = M.burst_labels(M.cross_wallet_bursts(fills(t), gap_us=6 * HOUR))
    return b.select(
        "market_id", "side", F.round("volume", 2).alias("volume"), "first_us", "last_us",
        F.col("trade_count").cast("long").alias("trade_count"), "members", "label",
    )


ORDERS_SQL = f"""{FILLS},
step AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {2 * DAY} THEN 0 ELSE 1 END AS s FROM fills WHERE usd > 0
   WINDOW w AS (PARTITION BY wallet, market_id, side ORDER BY ts_us, event_id)),
isl AS (SELECT *, sum(s) OVER (PARTITION BY wallet, market_id, side ORDER BY ts_us, event_id) AS g FROM step),
recon AS (SELECT wallet, market_id, side, g, sum(usd) AS total_usd, sum(usd * price) / sum(usd) AS avg_price, count(*) AS fill_count,
   min(ts_us) AS first_us, max(ts_us) AS last_us FROM isl GROUP BY ALL)"""


@query("w3_order_reconstruction", f"""WITH {ORDERS_SQL} SELECT wallet, market_id, side, round(total_usd, 4) AS total_usd,
 round(avg_price, 6) AS avg_price, fill_count, first_us, last_us,
 CASE WHEN fill_count = 1 THEN 'single' WHEN last_us - first_us < 5000000 THEN 'sweep' WHEN fill_count >= 5 THEN 'twap' ELSE 'iceberg' END AS order_type,
 last_us < {AS_OF_US - 2 * DAY} AS is_complete FROM recon""")
def _(t):
    o = M.reconstruct_orders(fills(t).filter("usd > 0"), AS_OF_US, gap_us=2 * DAY, slice_us=4 * DAY)
    return o.select(
        "wallet", "market_id", "side", F.round("total_usd", 4).alias("total_usd"), F.round("avg_price", 6).alias("avg_price"),
        "fill_count", "first_us", "last_us", "order_type", "is_complete",
    )


def entropy_sql(src, key, n_window):
    p = "greatest(1e-18, {v} / (b + s))"
    h = " + ".join(f"(-({p.format(v=v)}) * log2({p.format(v=v)}))" for v in ("b", "s"))
    return f"""fr AS (SELECT *, count(*) OVER w AS n_events, sum(CASE WHEN side = 'BUY' THEN size ELSE 0 END) OVER w AS b,
   sum(CASE WHEN side = 'SELL' THEN size ELSE 0 END) OVER w AS s FROM {src}
   WINDOW w AS (PARTITION BY {key} ORDER BY ts_us RANGE BETWEEN {n_window} PRECEDING AND CURRENT ROW)),
 ent AS (SELECT *, CASE WHEN n_events >= 2 AND round(b + s, 6) > 0 THEN {h} END AS entropy FROM fr)"""


@query("w4_rolling_entropy", f"""WITH {FILLS}, {entropy_sql('fills', 'market_id', 12 * HOUR)}
 SELECT event_id, market_id, n_events, round(entropy, 6) AS entropy FROM ent""")
def _(t):
    e = M.rolling_entropy(fills(t), 12 * HOUR, keys=["market_id"])
    return e.select("event_id", "market_id", "n_events", F.round("entropy", 6).alias("entropy"))


ZSCORE_SQL = f"""{FILLS}, {entropy_sql('fills', 'market_id', 12 * HOUR)},
 hist AS (SELECT *, entropy - lag(entropy) OVER o AS d, count(*) OVER f AS n_prior, var_samp(entropy) OVER f AS v FROM ent WHERE entropy IS NOT NULL
   WINDOW o AS (PARTITION BY market_id ORDER BY ts_us, event_id),
          f AS (PARTITION BY market_id ORDER BY ts_us, event_id ROWS BETWEEN 199 PRECEDING AND 1 PRECEDING)),
 zs AS (SELECT *, CASE WHEN n_prior >= 11 THEN greatest(-50.0, least(50.0, d / CASE WHEN v > 1e-12 THEN sqrt(v) ELSE 1e-6 END)) END AS z FROM hist)"""


def zscores(t):
    return M.entropy_zscore(M.rolling_entropy(fills(t), 12 * HOUR, keys=["market_id"]), keys=["market_id"])


@query("w5_entropy_zscore", f"""WITH {ZSCORE_SQL} SELECT event_id, market_id, n_prior, round(d, 4) + 0.0 AS delta_h, round(z, 4) + 0.0 AS z,
 z < -2.0 AS fires_shadow, z < -4.0 AS fires FROM zs WHERE z IS NOT NULL""")
def _(t):
    z = zscores(t).filter("z is not null")
    return z.select(
        "event_id", "market_id", "n_prior", F.round("delta_h", 4).alias("delta_h"), F.round("z", 4).alias("z"),
        (F.col("z") < -2.0).alias("fires_shadow"), (F.col("z") < -4.0).alias("fires"),
    )


WARM_SQL = f"""ses AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY market_id ORDER BY ts_us, event_id) AS session FROM trades),
 live AS (SELECT *, market_id || '|' || session AS ms FROM ses WHERE event_type <> 'signup'),
 stepd AS (SELECT *, coalesce(least(ts_us - lag(ts_us) OVER (PARTITION BY ms ORDER BY ts_us, event_id), {12 * HOUR}), 0) AS st FROM live),
 spand AS (SELECT *, sum(st) OVER (PARTITION BY ms ORDER BY ts_us, event_id) AS healthy_us FROM stepd),
 {entropy_sql('spand', 'ms', 12 * HOUR)},
 lockd AS (SELECT *, max(CASE WHEN session = 0 OR n_events >= 4 OR healthy_us >= {24 * HOUR} THEN 1 ELSE 0 END)
   OVER (PARTITION BY ms ORDER BY ts_us, event_id) AS unlocked FROM ent)"""


@query("w6_warmup_lock", f"""WITH {WARM_SQL} SELECT event_id, market_id, cast(session AS bigint) AS session, n_events, unlocked = 1 AS unlocked,
 round(CASE WHEN unlocked = 1 THEN entropy END, 6) AS entropy FROM lockd""")
def _(t):
    ticks, marks = t.trades.filter("event_type <> 'signup'"), t.trades.filter("event_type = 'signup'")
    e = M.warmup_entropy(ticks, marks, 12 * HOUR, 24 * HOUR, 4, slice_us=2 * DAY, key="market_id")
    return e.select(
        "event_id", "market_id", "session", "n_events", (F.col("unlocked") == 1).alias("unlocked"), F.round("entropy", 6).alias("entropy")
    )


MIDS_SQL = f"""{FILLS}, book AS (SELECT asset_id, ts_us, (bid + ask) / 2 AS mid FROM quotes WHERE bid > 0 AND ask > bid),
 tm AS (SELECT f.*, b.mid FROM fills f ASOF LEFT JOIN book b ON f.asset_id = b.asset_id AND f.ts_us >= b.ts_us)"""


def with_mids(t):
    return M.trades_with_mid(fills(t), t.quotes, 2 * DAY)


@query("j1_trade_asof_mid", f"WITH {MIDS_SQL} SELECT event_id, asset_id, price, round(mid, 6) AS mid FROM tm")
def _(t):
    return with_mids(t).select("event_id", "asset_id", "price", F.round("mid", 6).alias("mid"))


IMPACT_SQL = f"""{MIDS_SQL}, pv AS (SELECT *, lag(price) OVER w AS pp, lag(mid) OVER w AS pm, lag(ts_us) OVER w AS pt FROM tm
   WINDOW w AS (PARTITION BY asset_id ORDER BY ts_us, event_id)),
 impact AS (SELECT *, abs(price - pp) AS delta_price, abs(price - pp) / size AS lambda_obs FROM pv
   WHERE mid IS NOT NULL AND pm IS NOT NULL AND pp > 0 AND size > 0 AND ts_us - pt <= {DAY})"""


def impact(t):
    return M.price_impact(with_mids(t), ttl_us=DAY, slice_us=2 * DAY)


@query("w7_price_impact", f"WITH {IMPACT_SQL} SELECT event_id, asset_id, round(delta_price, 4) AS delta_price, size, round(lambda_obs, 6) AS lambda_obs FROM impact")
def _(t):
    return impact(t).select(
        "event_id", "asset_id", F.round("delta_price", 4).alias("delta_price"), "size", F.round("lambda_obs", 6).alias("lambda_obs")
    )


@query("w7_price_impact_by_order", f"""WITH {MIDS_SQL},
 step AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {2 * DAY} THEN 0 ELSE 1 END AS s FROM tm
   WINDOW w AS (PARTITION BY wallet, market_id, side ORDER BY ts_us, event_id)),
 isl AS (SELECT *, sum(s) OVER (PARTITION BY wallet, market_id, side ORDER BY ts_us, event_id) AS g FROM step),
 tot AS (SELECT *, sum(usd) OVER (PARTITION BY wallet, market_id, side, g) AS order_usd FROM isl),
 pv AS (SELECT *, lag(price) OVER w AS pp, lag(mid) OVER w AS pm, lag(ts_us) OVER w AS pt FROM tot
   WINDOW w AS (PARTITION BY asset_id ORDER BY ts_us, event_id))
 SELECT event_id, asset_id, round(order_usd, 4) AS order_usd, round(abs(price - pp) / greatest(order_usd, 0.01), 6) AS lambda_obs FROM pv
   WHERE mid IS NOT NULL AND pm IS NOT NULL AND pp > 0 AND size > 0 AND ts_us - pt <= {DAY}""")
def _(t):
    i = M.price_impact_by_order(with_mids(t), 2 * DAY, DAY, 2 * DAY)
    return i.select("event_id", "asset_id", F.round("order_usd", 4).alias("order_usd"), F.round("lambda_obs", 6).alias("lambda_obs"))


@query("w7_book_impact", f"""WITH {FILLS}, book AS (SELECT *, (bid + ask) / 2 AS mid FROM quotes WHERE bid > 0 AND ask > bid),
 tied AS (SELECT b.*, f.size AS trade_size, f.ts_us AS trade_us FROM book b ASOF LEFT JOIN fills f ON b.asset_id = f.asset_id AND b.ts_us >= f.ts_us),
 pv AS (SELECT *, lag(mid) OVER (PARTITION BY asset_id ORDER BY ts_us, event_id) AS pm FROM tied)
 SELECT event_id, asset_id, trade_size, round(abs(mid - pm) / trade_size, 6) AS lambda_obs FROM pv
 WHERE pm IS NOT NULL AND ts_us - trade_us <= {DAY} AND trade_size > 0""")
def _(t):
    i = M.book_impact(t.quotes, fills(t), DAY, 2 * DAY)
    return i.select("event_id", "asset_id", "trade_size", F.round("lambda_obs", 6).alias("lambda_obs"))


@query("w8_flow_shocks", f"""WITH st AS (SELECT *, price * size AS notional, lag(ts_us) OVER (PARTITION BY coin ORDER BY ts_us, event_id) AS pt
   FROM lead_trades WHERE price > 0 AND size > 0 AND ts_us > 0),
 kept AS (SELECT * FROM st WHERE pt IS NULL OR ts_us - pt <= {6 * HOUR}),
 fr AS (SELECT *, count(*) OVER w AS n_events, sum(notional) OVER w AS total_usd,
   sum(notional * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) OVER w AS ofi, min(ts_us) OVER w AS first_us FROM kept
   WINDOW w AS (PARTITION BY coin ORDER BY ts_us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)),
 hit AS (SELECT * FROM fr WHERE n_events >= 2 AND round(total_usd, 4) >= 10 AND round(abs(ofi) / total_usd, 9) >= 0.6)
 SELECT h.event_id, h.coin, h.n_events, round(h.total_usd, 4) AS total_usd, round(h.ofi, 4) + 0.0 AS ofi, h.ts_us - h.first_us AS delta_us,
   round(a.mid, 6) AS price_after, round(b.mid, 6) AS price_before
 FROM hit h ASOF LEFT JOIN lead_quotes a ON h.coin = a.coin AND h.ts_us >= a.ts_us
   ASOF LEFT JOIN lead_quotes b ON h.coin = b.coin AND h.first_us >= b.ts_us""")
def _(t):
    s = M.flow_shocks(t.lead_trades, t.lead_quotes, 6 * HOUR, 10.0, 0.6, 6 * HOUR, slice_us=DAY)
    return s.select(
        "event_id", "coin", "n_events", F.round("total_usd", 4).alias("total_usd"), F.round("ofi", 4).alias("ofi"),
        "delta_us", F.round("price_after", 6).alias("price_after"), F.round("price_before", 6).alias("price_before"),
    )


@query("w18_cooldown_triggers", f"""WITH RECURSIVE cand AS (SELECT market_id, ts_us, event_id, usd FROM trades WHERE usd >= 5),
 nxt AS (SELECT c.market_id, c.ts_us, (SELECT min(d.ts_us) FROM cand d WHERE d.market_id = c.market_id AND d.ts_us >= c.ts_us + {6 * HOUR}) AS n FROM cand c),
 trig AS (SELECT market_id, min(ts_us) AS ts_us FROM cand GROUP BY market_id
   UNION ALL SELECT t.market_id, x.n FROM trig t JOIN nxt x ON x.market_id = t.market_id AND x.ts_us = t.ts_us WHERE x.n IS NOT NULL)
 SELECT c.market_id, c.ts_us, c.event_id, c.usd FROM cand c JOIN trig USING (market_id, ts_us)""")
def _(t):
    return M.cooldown_triggers(t.trades, 5.0, 6 * HOUR, slice_us=10 * DAY)


LABEL_SQL = f"""{SWEEPS_SQL},
 gaps AS (SELECT wallet, greatest(0, first_us - lag(last_us) OVER (PARTITION BY wallet ORDER BY first_us, first_event)) AS gap,
   row_number() OVER (PARTITION BY wallet ORDER BY first_us, first_event) AS k FROM sweeps),
 ranked AS (SELECT wallet, cast(gap AS double) AS gap, row_number() OVER (PARTITION BY wallet ORDER BY gap) AS i FROM gaps WHERE k > 1),
 gi AS (SELECT wallet, CASE WHEN sum(gap) <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 2 * sum(i * gap) / (count(*) * sum(gap)) - (count(*) + 1.0::double) / count(*))) END AS burst
   FROM ranked GROUP BY wallet),
 idi AS (SELECT wallet, count(*) AS parents, abs(sum(CASE WHEN side = 'BUY' THEN volume ELSE -volume END)) / CASE WHEN sum(volume) = 0 THEN 1 ELSE sum(volume) END AS idi
   FROM sweeps GROUP BY wallet)"""


@query("a12_imbalance_index", f"WITH {LABEL_SQL} SELECT wallet, parents, round(idi, 6) AS idi FROM idi")
def _(t):
    return M.imbalance_index(sweeps(t)).select("wallet", "parents", F.round("idi", 6).alias("idi"))


@query("a13_gap_gini", f"WITH {LABEL_SQL} SELECT wallet, round(burst, 6) AS burst FROM gi")
def _(t):
    return M.burstiness(sweeps(t)).select("wallet", F.round("burst", 6).alias("burst"))


@query("a14_wallet_labels", f"""WITH {LABEL_SQL} SELECT wallet, parents, round(idi, 6) AS idi, round(coalesce(burst, 0), 6) AS burst,
 CASE WHEN parents < 40 THEN 'POTENTIAL_INSIDER' WHEN idi > 0.3 AND burst > 0.4 THEN 'INSIDER_ALGO_SLICING'
   WHEN idi < 0.1 AND 0.8 < 0.9 THEN 'MARKET_MAKER_NOISE' ELSE 'UNCERTAIN_NOISE' END AS label FROM idi LEFT JOIN gi USING (wallet)""")
def _(t):
    l = M.wallet_labels(sweeps(t), min_parents=40, idi_high=0.3, burst_high=0.4, idi_low=0.1, taker_low=0.9)
    return l.select("wallet", "parents", F.round("idi", 6).alias("idi"), F.round("burst", 6).alias("burst"), "label")
