"""Registered streaming queries: each runs its stream to the end and returns what it wrote."""

import uuid

from pyspark.sql import functions as F

from tapewatch.catalog import query
from tapewatch.operators import predicates as P
from tapewatch.operators.lineage import checkpoint_folder
from tapewatch.operators.sequence import DAY, HOUR
from tapewatch.registry.join_queries import LEGS_SQL
from tapewatch.registry.micro import FILLS, ZSCORE_SQL
from tapewatch.sources import sinks as K
from tapewatch.streaming import jobs as S


def stream_fills(t, delay_us=HOUR):
    return S.with_event_time(S.closed(P.filled_only(t.stream("trades")).filter("usd > 0")), delay_us)


@query("st1_entropy_stream", f"""WITH {ZSCORE_SQL.replace('PARTITION BY market_id', 'PARTITION BY market_id')} SELECT market_id, event_id, round(entropy, 6) AS entropy, round(z, 4) + 0.0 AS z FROM zs""")
def _(t):
    ticks = P.filled_only(t.stream("trades")).withColumn("asset_id", F.col("market_id"))
    out = S.run_available(S.entropy_signals(ticks, 12 * HOUR)).filter("not late and entropy is not null")
    return out.select(F.col("asset_id").alias("market_id"), "event_id", F.round("entropy", 6).alias("entropy"), F.round("z", 4).alias("z"))


@query("st2_flow_shocks", f"""WITH st AS (SELECT *, price * size AS notional, lag(ts_us) OVER (PARTITION BY coin ORDER BY ts_us, event_id) AS pt FROM lead_trades WHERE price > 0 AND size > 0), kept AS (SELECT * FROM st WHERE pt IS NULL OR ts_us - pt <= {6 * HOUR}),
 fr AS (SELECT *, count(*) OVER w AS n_events, sum(notional) OVER w AS total_usd, sum(notional * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) OVER w AS ofi FROM kept WINDOW w AS (PARTITION BY coin ORDER BY ts_us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW))
 SELECT coin, event_id, n_events, round(total_usd, 4) AS total_usd, round(ofi, 4) + 0.0 AS ofi FROM fr WHERE n_events >= 2 AND round(total_usd, 4) >= 10 AND round(abs(ofi) / total_usd, 9) >= 0.6""")
def _(t):
    out = S.run_available(S.flow_shocks(t.stream("lead_trades"), 6 * HOUR, 10.0, 0.6, 6 * HOUR)).filter("not late")
    return out.select("coin", "event_id", "n_events", F.round("total_usd", 4).alias("total_usd"), F.round("ofi", 4).alias("ofi"))


@query("st3_order_sessions", f"""WITH {FILLS}, step AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {DAY} THEN 0 ELSE 1 END AS s FROM fills WHERE usd > 0 WINDOW w AS (PARTITION BY wallet, market_id, side ORDER BY ts_us, event_id)),
 isl AS (SELECT *, sum(s) OVER (PARTITION BY wallet, market_id, side ORDER BY ts_us, event_id) AS g FROM step), r AS (SELECT wallet, market_id, side, g, sum(usd) AS total_usd, count(*) AS fill_count, min(ts_us) AS first_us, max(ts_us) AS last_us FROM isl GROUP BY ALL)
 SELECT wallet, market_id, side, round(total_usd, 4) AS total_usd, fill_count, first_us, last_us, CASE WHEN fill_count = 1 THEN 'single' WHEN last_us - first_us < 5000000 THEN 'sweep' WHEN fill_count >= 5 THEN 'twap' ELSE 'iceberg' END AS order_type
 FROM r""")
def _(t):
    out = S.run_available(S.order_sessions(stream_fills(t), DAY))
    return out.select("wallet", "market_id", "side", F.round("total_usd", 4).alias("total_usd"), "fill_count", "first_us", "last_us", "order_type")


@query("st4_market_windows", f"""SELECT market_id, ts_us // {6 * HOUR} * {6 * HOUR} AS window_us, count(*) AS trades, round(sum(usd), 4) AS usd FROM trades GROUP BY 1, 2""")
def _(t):
    out = S.run_available(S.market_windows(S.with_event_time(S.closed(t.stream("trades")), HOUR), 6 * HOUR))
    return out.withColumn("usd", F.round("usd", 4))


@query("st5_rate_counters", f"""WITH w AS (SELECT event_type, ts_us // {3 * HOUR} * {3 * HOUR} - k * {3 * HOUR} AS window_us FROM trades, (VALUES (0), (1), (2), (3)) v(k)) SELECT event_type, window_us, count(*) AS events FROM w GROUP BY 1, 2""")
def _(t):
    return S.run_available(S.rate_counters(S.with_event_time(S.closed(t.stream("trades")), HOUR), 12 * HOUR, 3 * HOUR))


@query("st6_signal_observation_join", f"""SELECT s.event_id AS signal_id, s.market_id, o.address, o.obs_id FROM trades s JOIN observations o ON o.market_id = s.market_id AND o.ts_us >= s.ts_us - {12 * HOUR} AND o.ts_us <= s.ts_us + {HOUR} WHERE s.event_type = 'purchase'""")
def _(t):
    sig = S.with_event_time(t.stream("trades").filter("event_type = 'purchase'"), 2 * HOUR).select(F.col("event_id").alias("signal_id"), "market_id", "at")
    obs = S.with_event_time(t.stream("observations"), 2 * HOUR)
    return S.run_available(S.signals_with_observations(sig, obs, 12 * HOUR, HOUR))


@query("st7_dedupe", "SELECT tx_hash, 1::bigint AS n FROM trades")
def _(t):
    twice = t.stream("trades").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = S.run_available(S.once(S.with_event_time(twice, HOUR), "tx_hash").select("tx_hash", "event_id", "at"))
    return out.groupBy("tx_hash").agg(F.count(F.lit(1)).alias("n"))


@query("st8_late_rows", """WITH m AS (SELECT market_id, max(ts_us) AS cursor FROM trades WHERE event_id % 5 <> 0 GROUP BY 1)
 SELECT market_id, count(*) FILTER (event_id % 5 <> 0 OR cursor IS NULL OR ts_us > cursor) AS kept, count(*) FILTER (event_id % 5 = 0 AND ts_us <= cursor) AS late FROM trades LEFT JOIN m USING (market_id) GROUP BY 1""")
def _(t):
    """A fifth of the trades arrives in later files: what lies behind its market's cursor by then comes out as late, after a restart too."""
    rows = t.trades.select("event_id", "ts_us", "side", "size", F.col("market_id").alias("asset_id"))
    root = f"{checkpoint_folder(rows)}/late-{uuid.uuid4().hex}"
    for part in ("event_id % 5 <> 0", "event_id % 5 = 0"):
        rows.filter(part).write.mode("append").parquet(f"{root}/rows")
        stream = rows.sparkSession.readStream.schema(rows.schema).parquet(f"{root}/rows")
        out = S.run_available(S.entropy_signals(stream, 12 * HOUR), root=f"{root}/run")
    return out.groupBy(F.col("asset_id").alias("market_id")).agg(F.count_if(~F.col("late")).alias("kept"), F.count_if("late").alias("late"))


@query("st9_arbitrage_legs", f"WITH {LEGS_SQL}, lg AS (SELECT market_id, event_id, round(yp + np, 4) AS total, least(ys, ns) AS depth FROM legs WHERE round(yp + np, 6) < 0.97 AND least(ys, ns) >= 50) SELECT * FROM lg")
def _(t):
    asks = S.with_event_time(t.stream("trades"), HOUR).select("event_id", "market_id", "ts_us", "outcome", F.col("price").alias("ask"), (F.col("size") * 10).alias("ask_size"), "at")
    out = S.run_available(S.arbitrage_legs(asks, 0.97, 50.0, 400 * DAY)).filter("not late")
    return out.select("market_id", "event_id", F.round("total", 4).alias("total"), "depth")


@query("st10_upsert_sink", "SELECT wallet, max(price) AS best_price, count(*) AS trades, max(ts_us) AS updated_us FROM trades GROUP BY 1")
def _(t):
    policies = {"best_price": K.MAXIMUM, "trades": K.COUNTER}

    def merge(old, batch):
        rows = batch.select("wallet", F.col("ts_us").alias("updated_us"), F.col("price").alias("best_price"), F.lit(0).cast("long").alias("trades"))
        return K.upsert(rows.limit(0) if old is None else old, rows, ["wallet"], policies, "updated_us")

    stream = t.stream("trades")
    return S.upsert_sink(stream, merge, f"{checkpoint_folder(stream)}/upsert-{uuid.uuid4().hex}")


@query("st11_cooldown", f"""WITH RECURSIVE cand AS (SELECT market_id, ts_us, event_id, usd FROM trades WHERE usd >= 5),
 nxt AS (SELECT c.market_id, c.ts_us, (SELECT min(d.ts_us) FROM cand d WHERE d.market_id = c.market_id AND d.ts_us >= c.ts_us + {6 * HOUR}) AS n FROM cand c),
 trig AS (SELECT market_id, min(ts_us) AS ts_us FROM cand GROUP BY market_id UNION ALL SELECT t.market_id, x.n FROM trig t JOIN nxt x ON x.market_id = t.market_id AND x.ts_us = t.ts_us WHERE x.n IS NOT NULL)
 SELECT c.market_id, c.event_id, c.ts_us, c.usd FROM cand c JOIN trig USING (market_id, ts_us)""")
def _(t):
    return S.run_available(S.cooldown_triggers(t.stream("trades"), 5.0, 6 * HOUR))


@query("st11_first_alerts", """SELECT wallet || ':' || outcome AS alert_key, min(ts_us) AS ts_us, arg_min(event_id, ts_us) AS event_id FROM trades WHERE usd >= 2 GROUP BY 1""")
def _(t):
    keyed = t.stream("trades").filter("usd >= 2").withColumn("alert_key", F.concat_ws(":", "wallet", "outcome"))
    return S.run_available(S.first_alerts(keyed))
