"""Coverage, activity, health and insight reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import fixed as X
from tapewatch.operators import scalars as S
from tapewatch.operators.lineage import cut_lineage
from tapewatch.operators.performance import one_row
from tapewatch.operators.sequence import DAY, HOUR, US, top_per_key, value_at_rank

OK = lambda: F.col("accepted") == 1


def tier_coverage(executions: DataFrame, since_us: int) -> DataFrame:
    """Signals, accepted, rejected, averages, markets and pass rate per tier since a time."""
    return executions.filter(F.col("created_us") > since_us).groupBy("tier").agg(
        F.count(F.lit(1)).alias("total_signals"), F.count_if(OK()).alias("accepted"), F.count_if(~OK()).alias("rejected"),
        F.avg(F.when(OK(), F.col("ev_net"))).alias("avg_ev"), F.avg("posterior").alias("avg_posterior"),
        F.countDistinct("market_id").alias("distinct_markets"),
    ).withColumn("pass_rate", F.round(F.col("accepted") / F.col("total_signals"), 3))


def active_markets(executions: DataFrame, since_us: int, newest: int = 100) -> DataFrame:
    """The most recently active markets of each tier with their signal statistics."""
    ok = OK()
    stats = executions.filter(F.col("created_us") > since_us).groupBy("tier", "market_id").agg(
        F.count(F.lit(1)).alias("total_signals"), F.count_if(ok).alias("accepted"), F.max("created_us").alias("last_us"),
        F.avg(F.when(ok, F.col("ev_net"))).alias("avg_ev"),
    )
    return top_per_key(stats, "tier", [F.desc("last_us"), F.asc("market_id")], newest)


def coverage_summary(log: DataFrame, since_us: int, by_tier: bool = True) -> DataFrame:
    """Identity-coverage statistics, overall or per tier."""
    rows = log.filter(F.col("ts_us") > since_us)
    return (rows.groupBy("tier") if by_tier else rows.groupBy()).agg(
        F.countDistinct("market_id").alias("distinct_markets"), F.count(F.lit(1)).alias("total_polls"),
        F.avg("loss_rate").alias("avg_loss"), F.max("loss_rate").alias("max_loss"), F.avg("wallet_coverage").alias("avg_wallet_coverage"),
        F.count_if("page_saturated").alias("saturated_polls"), F.sum("ws_ticks").alias("total_ws"), F.sum("api_received").alias("total_api"),
    )


def impact_p75(samples: DataFrame, min_samples: int = 10, min_assets: int = 3) -> DataFrame:
    """75th-percentile price impact per asset; assets with few samples fall back to the overall value."""
    rank = F.floor(F.col("n") * 0.75)
    own = value_at_rank(samples, "asset_id", "lambda_obs", rank, "own_p75")
    whole = value_at_rank(samples.withColumn("_all", F.lit(1)), "_all", "lambda_obs", rank, "global_p75", one_key=True)
    assets = samples.agg(F.countDistinct("asset_id").alias("_assets")).withColumn("_all", F.lit(1))
    fallback = whole.join(assets, "_all").select(
        "_all", F.when((F.col("n") >= min_samples) & (F.col("_assets") >= min_assets), F.col("global_p75")).alias("global_p75")
    )
    out = own.withColumn("_all", F.lit(1)).join(F.broadcast(fallback), "_all", "left").drop("_all")
    local = F.when(F.col("n") >= min_samples, F.col("own_p75"))
    return out.withColumn("own_p75", local).withColumn("p75", F.coalesce("own_p75", "global_p75"))


def hourly_impact(samples: DataFrame, since_us: int) -> DataFrame:
    hour = (F.floor(F.col("ts_us") / HOUR) * HOUR).cast("long").alias("hour_us")
    return samples.filter(F.col("ts_us") > since_us).groupBy(hour).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("lambda_obs").alias("avg_lambda"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


def paper_by_tier(executions: DataFrame, since_us: int) -> DataFrame:
    rows = executions.filter((F.col("created_us") > since_us) & (F.col("mode") == "PAPER"))
    return rows.groupBy("tier").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("ev_net").alias("avg_ev"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us")
    )


def asset_activity(samples: DataFrame, limit: int = 10) -> DataFrame:
    """Assets with most samples and their distinct active hours."""
    by_hour = samples.groupBy("asset_id", F.floor(F.col("ts_us") / HOUR).alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lambda_obs").alias("s"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b")
    )
    agg = by_hour.groupBy("asset_id").agg(
        F.sum("n").alias("samples"), (F.sum("s") / F.sum("n")).alias("avg_lambda"), F.count(F.lit(1)).alias("active_hours"),
        F.min("a").alias("first_us"), F.max("b").alias("last_us"),
    )
    return agg.orderBy(F.desc("samples"), "asset_id").limit(limit)


def with_payload(observations: DataFrame) -> DataFrame:
    """Observations with side, outcome, price, size and USD read from the payload."""
    p = F.col("payload_json")
    return (
        observations.withColumn("side", F.get_json_object(p, "$.side")).withColumn("outcome", F.get_json_object(p, "$.outcome"))
        .withColumn("price", S.payload_number(p, ["price"])).withColumn("size", S.payload_number(p, ["size", "amount"]))
        .withColumn("usd", F.col("size") * F.col("price"))
    )


def top_wallets(trades: DataFrame, limit: int = 50) -> DataFrame:
    agg = trades.groupBy("wallet").agg(F.sum("usd").alias("usd_volume"), F.count(F.lit(1)).alias("trade_count"))
    return agg.orderBy(F.desc("usd_volume"), "wallet").limit(limit)


def histogram(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    return df.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def price_bucket(p: Column) -> Column:
    """Inclusive ranges tried in order."""
    return (
        F.when(p < 0.20, "< 0.20").when(p.between(0.20, 0.40), "0.20-0.40").when(p.between(0.40, 0.60), "0.40-0.60")
        .when(p.between(0.60, 0.80), "0.60-0.80").otherwise(">= 0.80")
    )


def usd_bucket(u: Column) -> Column:
    return (
        F.when(u < 10, "< $10").when(u.between(10, 50), "$10-$50").when(u.between(50, 100), "$50-$100").when(u.between(100, 500), "$100-$500").otherwise(">= $500")
    )


def score_bucket(s: Column) -> Column:
    return (
        F.when(s >= 0.80, "0.80+ (high confidence)").when(s >= 0.65, "0.65-0.80 (elevated)").when(s >= 0.55, "0.55-0.65 (threshold)")
        .when(s >= 0.40, "0.40-0.55 (moderate)").otherwise("< 0.40 (low)")
    )


def token_breakdown(rows: DataFrame, limit: int = 20) -> DataFrame:
    per_wallet = rows.groupBy("token_id", "address").agg(F.count(F.lit(1)).alias("n"), F.sum("usd").alias("u"))
    agg = per_wallet.groupBy("token_id").agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("wallets"), F.sum("u").alias("total_usd"))
    return agg.orderBy(F.desc("observations"), "token_id").limit(limit)


def trade_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("address").alias("wallets"), F.sum("usd").alias("total_usd"), F.avg("usd").alias("avg_usd"),
        F.min("usd").alias("min_usd"), F.max("usd").alias("max_usd"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )


def injected_wallets(rows: DataFrame, injected: Column) -> DataFrame:
    """Distinct wallets and how many of them came from injection."""
    per = rows.groupBy("address").agg(F.max(injected.cast("int")).alias("_i"))
    out = per.agg(F.count(F.lit(1)).alias("wallets"), F.coalesce(F.sum("_i"), F.lit(0)).alias("injected"))
    return out.withColumn("injected_share", F.when(F.col("wallets") > 0, F.col("injected") / F.col("wallets")))


def outcome_rate(hits: DataFrame, min_rows: int = 5) -> DataFrame:
    """Win rate over decided hits (null below ``min_rows``) and z statistics over all hits."""
    decided = F.col("outcome").isin("win", "loss")
    n = F.count_if(decided)
    return hits.agg(
        F.count(F.lit(1)).alias("hits"), F.when(n >= min_rows, F.count_if(F.col("outcome") == "win") / F.greatest(F.lit(1), n)).alias("win_rate"),
        F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("avg_z"),
    )


def insight_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def source_shares(wallets: DataFrame, source: str) -> DataFrame:
    """Wallets per discovery source with their share of all wallets."""
    counts = wallets.groupBy(source).agg(F.count(F.lit(1)).alias("wallets"))
    total = counts.agg(F.sum("wallets").alias("_t")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        source, "wallets", F.round(F.col("wallets") / F.greatest(F.lit(1), F.col("_t")), 3).alias("share")
    )


def health_snapshots(parts: dict[str, tuple[DataFrame, str]], window_us: int, target_samples: int = 500) -> DataFrame:
    """Per time window: row counts of every feed and the derived rates.

    ``parts`` maps a counter name to (rows, time column) and must hold ``trade_ticks,
    entropy_fires, impact_samples, updates, paper_trades, live_trades, observations``. Each feed
    is counted per window before the counters are combined.
    """
    tall = None
    for name, (df, ts) in parts.items():
        w = (F.floor(F.col(ts) / window_us) * window_us).cast("long").alias("window_us")
        part = df.groupBy(w).agg(F.count(F.lit(1)).alias("n")).select("window_us", F.lit(name).alias("k"), "n")
        tall = part if tall is None else tall.unionByName(part)
    wide = tall.groupBy("window_us").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k) for k in parts])
    minutes = window_us / (60 * US)
    total = parts["impact_samples"][0].agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    wide = wide.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    return (
        wide.withColumn("tick_rate", F.round(F.col("trade_ticks") / max(minutes, 1), 2))
        .withColumn("pass_rate", F.round(F.col("paper_trades") / F.greatest(F.col("updates"), F.lit(1)), 4))
        .withColumn("accumulation", F.round(F.col("_total") / target_samples, 4))
        .withColumn("stale", ((F.col("entropy_fires") > 0) & (F.col("paper_trades") == 0)) | (F.col("live_trades") > 0))
        .drop("_total")
    )


# Alert thresholds per mode.
ALERT_LIMITS = {"shadow": {"live": 0, "observations": 1}, "production": {"live": 0, "observations": 5}}


def health_alerts(snapshots: DataFrame, mode: str = "shadow") -> DataFrame:
    """One row per alert raised by a snapshot."""
    lim = ALERT_LIMITS.get(mode, ALERT_LIMITS["shadow"])
    c = F.col
    alert = lambda cond, sev, layer, code, value: F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(layer).alias("layer"), F.lit(code).alias("code"), value.cast("double").alias("value")))
    found = F.array_compact(F.array(
        alert(c("live_trades") > lim["live"], "CRITICAL", "L4", "live_trades", c("live_trades")),
        alert(c("observations") < lim["observations"], "WARN", "L5", "no_observations", c("observations")),
        alert(F.lit(True), "INFO", "L1", "rates", c("tick_rate")),
        alert(c("stale") & (c("entropy_fires") > 0), "WARN", "L3/L4", "gate_blocking", F.lit(0.0)),
        alert(c("accumulation") < 0.1, "WARN", "L1", "impact_stalled", c("accumulation")),
    ))
    return snapshots.select("window_us", F.explode(found).alias("a")).select("window_us", "a.*")


def metric_snapshot(
    ticks: DataFrame, books: DataFrame, gates: DataFrame, z_values: DataFrame, samples: DataFrame, settled: DataFrame, now_us: int,
    window_us: int = 60 * US, impact_us: int = 300 * US,
) -> DataFrame:
    """Trailing counters, mean z and posterior, impact P75 and the go-live lock as one row."""
    since = lambda df, ts, w: df.filter((F.col(ts) > now_us - w) & (F.col(ts) <= now_us))
    n = F.count(F.lit(1))
    g = since(gates, "created_us", window_us).agg(n.alias("gate_evaluated"), F.count_if(OK()).alias("gate_passed"), F.avg(F.when(OK(), F.col("ev_net"))).alias("avg_ev"), F.avg("posterior").alias("mean_posterior"))
    recent = since(samples, "ts_us", impact_us)
    p75 = value_at_rank(recent.withColumn("_all", F.lit(1)), "_all", "lambda_obs", F.floor(F.col("n") * 0.75), "impact_p75", one_key=True).select(F.col("n").alias("impact_samples"), "impact_p75")
    wins = settled.agg(n.alias("paper_trades"), F.count_if(F.col("pnl") > 0).alias("paper_wins"))
    row = one_row(
        since(ticks, "ts_us", window_us).agg(n.alias("trade_ticks")), since(books, "ts_us", window_us).agg(n.alias("book_events")), g,
        since(z_values, "ts_us", impact_us).agg(F.avg("z").alias("mean_z")), p75, wins, recent.agg(F.countDistinct("asset_id").alias("impact_assets")),
    )
    rate = F.when(F.col("paper_trades") > 0, F.col("paper_wins") / F.col("paper_trades")).otherwise(0.0)
    row = row.withColumn("win_rate", rate)
    ready = (F.coalesce("impact_samples", F.lit(0)) >= 500) & (F.col("paper_trades") >= 100) & (F.col("win_rate") >= 0.55)
    return row.withColumn("locked", ~ready)


def rate_counts(events: DataFrame, window_us: int = 60 * US, step_us: int = 5 * US) -> DataFrame:
    """Events per sliding window, counted per step first so each event is copied once per step only."""
    steps = events.groupBy((F.floor(F.col("ts_us") / step_us) * step_us).cast("long").alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    starts = F.sequence(F.col("_step") - F.lit(window_us - step_us), F.col("_step"), F.lit(step_us))
    return steps.select(F.explode(starts).alias("window_us"), "_n").groupBy("window_us").agg(F.sum("_n").alias("events"))


def daily_counts(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per kind and day."""
    out = None
    for name, (df, ts) in parts.items():
        day = (F.floor(F.col(ts) / DAY) * DAY).cast("long").alias("day_us")
        part = df.groupBy(day).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "day_us", "n")
        out = part if out is None else out.unionByName(part)
    return out


def link_stats(links: DataFrame, unresolved: DataFrame, reservations: DataFrame) -> DataFrame:
    return one_row(
        links.agg(F.count(F.lit(1)).alias("mappings")),
        unresolved.agg(F.count_if(~F.col("resolved")).alias("open"), F.count_if("resolved").alias("closed")),
        reservations.agg(F.coalesce(F.sum(F.when(F.col("status") == "RESERVED", F.col("amount"))), F.lit(0.0)).alias("reserved_usd")),
    )


def book_depth(books: DataFrame, levels: int = 10) -> DataFrame:
    """Value of the top levels per side and the spread, from level arrays ``bids`` and ``asks``."""
    value = lambda c: F.aggregate(F.slice(F.col(c), 1, levels), F.lit(0.0), lambda acc, x: acc + x["price"] * x["size"])
    both = (F.size("bids") > 0) & (F.size("asks") > 0)
    return books.withColumn("bid_depth", value("bids")).withColumn("ask_depth", value("asks")).withColumn(
        "spread", F.when(both, F.get("asks", F.lit(0))["price"] - F.get("bids", F.lit(0))["price"]).otherwise(0.0)
    )


def sample_quality(samples: DataFrame) -> DataFrame:
    """Per market window: share of good books, ask range, trade rate class and spread verdict."""
    tps = F.when(F.col("trades_per_sec") > 0, F.col("trades_per_sec"))
    agg = samples.groupBy("slug").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("book_ok").alias("book_ok"), F.min("best_ask_raw").alias("min_ask"), F.max("best_ask_raw").alias("max_ask"),
        F.min("best_bid_raw").alias("_min_bid"), F.avg(tps).alias("avg_tps"), F.max(tps).alias("max_tps"),
    )
    speed = F.when(F.col("avg_tps") >= 1, "EXTREME").when(F.col("avg_tps") >= 0.1, "MODERATE").when(F.col("avg_tps").isNotNull(), "ILLIQUID").otherwise("NO_TRADES")
    spread = F.col("max_ask") - F.col("_min_bid")
    return agg.withColumn("liquidity", speed).withColumn("verdict", F.when(spread > 0.85, "AMM").when(spread.isNotNull(), "CLOB")).drop("_min_bid")


def opportunity_stats(updates: DataFrame, opportunities: DataFrame, now_us: int) -> DataFrame:
    return one_row(
        updates.agg(F.count(F.lit(1)).alias("total_updates"), F.countDistinct("asset_id").alias("active_tokens")),
        opportunities.agg(
            F.count(F.lit(1)).alias("opportunities"), F.count_if(F.lit(now_us) - F.col("ts_us") < HOUR).alias("opportunities_1h"),
            F.coalesce(F.max("profit_per_100"), F.lit(0.0)).alias("best_profit"),
        ),
    )


def first_seen(observations: DataFrame) -> DataFrame:
    return observations.groupBy("address").agg(F.min("ts_us").alias("first_us"))


def recent_wallets(observations: DataFrame, limit: int = 40) -> DataFrame:
    """Most recently trading wallets, the zero address excluded."""
    rows = observations.filter((F.col("obs_type") == "clob_trade") & (F.col("address") != X.ZERO_ADDRESS))
    return rows.groupBy("address").agg(F.max("ts_us").alias("last_us")).orderBy(F.desc("last_us"), "address").limit(limit)


def system_status(executions: DataFrame) -> DataFrame:
    """State of the newest execution."""
    last = executions.agg(F.max_by(F.struct("execution_id", "accepted", "reason", "created_us"), F.struct("created_us", "execution_id")).alias("l")).select("l.*")
    return last.select(
        F.when(F.col("execution_id").isNull(), "idle").when(F.col("accepted") == 1, "executed").otherwise("rejected").alias("state"),
        F.col("execution_id").alias("last_execution_id"), "created_us", F.when(F.col("accepted") == 0, F.col("reason")).alias("reject_reason"),
    )


def tier1_entities(entities: DataFrame, tags: list[str], min_trust: float = 70.0, since_us: int | None = None) -> DataFrame:
    fit = (F.col("trust_score") >= min_trust) & F.col("primary_tag").isin(tags)
    if since_us is not None:
        fit = fit & (F.col("updated_us") >= since_us)
    return entities.agg(F.count_if(fit).alias("tier1_entities"))


def entropy_diagnostics(z: DataFrame, key: str, threshold: float, unlocked: str = "unlocked") -> DataFrame:
    """Evaluation counts by state and nearest-rank P50 and P90 of z per key (Python-style rounding to even)."""
    z = cut_lineage(z)
    ready = F.col("z").isNotNull()
    counts = z.groupBy(key).agg(
        F.count(F.lit(1)).alias("evaluations"), F.count_if(~ready & ~F.col(unlocked)).alias("locked"), F.count_if(~ready & F.col(unlocked)).alias("warming"),
        F.count_if(ready).alias("ready"), F.count_if(ready & (F.col("z") < threshold)).alias("below"),
    )
    at = lambda p, n: value_at_rank(z, key, "z", F.bround((F.col("n") - 1) * p, 0), n).drop("n")
    return counts.join(at(0.5, "p50"), key, "left").join(at(0.9, "p90"), key, "left")


def execution_reasons(executions: DataFrame, since_us: int) -> DataFrame:
    return executions.filter(F.col("created_us") > since_us).groupBy("reason", "accepted").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us")
    )


def newest(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Global order and limit; only ``limit`` rows per task reach the final merge."""
    return df.orderBy(*order).limit(limit)


def priority_fill(tokens: DataFrame, limit: int = 200) -> DataFrame:
    """Tokens by (priority, position) up to a cap, each token once at its best place."""
    best = tokens.groupBy("token_id").agg(F.min(F.struct("priority", "position")).alias("p"))
    return best.select("token_id", "p.*").orderBy("priority", "position", "token_id").limit(limit)
