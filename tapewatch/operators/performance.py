"""Profit, risk-adjusted return, drawdown and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.sequence import DAY, fit_width, previous_row, running, top_per_key


def equity_curve(settled: DataFrame, key: str, slice_us: int = 30 * DAY) -> DataFrame:
    """Cumulative PnL, running peak (above zero), drawdown and the row that set the peak."""
    order, slice_us = ["closed_us", "trade_id"], fit_width(settled, key, "closed_us", slice_us)
    summed = running(settled, key, order, "closed_us", slice_us, {"equity": ("sum", F.coalesce("pnl", F.lit(0.0)))})
    # The earliest row of the highest equity: later ties lose through the negated order.
    high = F.when(F.col("equity") > 0, F.struct(F.col("equity").alias("e"), (-F.col("closed_us")).alias("c"), (-F.col("trade_id")).alias("t")))
    out = running(summed, key, order, "closed_us", slice_us, {"_peak": ("max", high)})
    drawdown = F.when(F.col("_peak").isNotNull(), (F.col("_peak.e") - F.col("equity")) / F.col("_peak.e")).otherwise(0.0)
    return out.select(
        *settled.columns, "equity", F.coalesce("_peak.e", F.lit(0.0)).alias("peak"), drawdown.alias("drawdown"),
        (-F.col("_peak.t")).alias("peak_trade_id"), (-F.col("_peak.c")).alias("peak_us"),
    )


def sharpe(n: Column, mean: Column, spread: Column) -> Column:
    return F.when((n > 1) & (spread > 0), mean / spread * F.sqrt(n)).otherwise(0.0)


def performance(settled: DataFrame, key: str, slice_us: int = 30 * DAY) -> DataFrame:
    """Per key: PnL, win rate without ties, Sharpe, profit factor, slippage gap and deepest drawdown."""
    curve = equity_curve(settled, key, slice_us)
    pnl = F.coalesce("pnl", F.lit(0.0))
    # Exact first maximum: the deepest drawdown with the earliest row.
    deepest = F.max(F.when(F.col("drawdown") > 0, F.struct(F.col("drawdown").alias("d"), (-F.col("closed_us")).alias("c"), (-F.col("trade_id")).alias("t"), "peak_trade_id")))
    agg = curve.groupBy(key).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("_mean"), F.stddev_pop(pnl).alias("_sd"),
        F.count_if(pnl > 0).alias("_w"), F.count_if(pnl < 0).alias("_l"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("_gp"), F.abs(F.coalesce(F.sum(F.when(pnl < 0, pnl)), F.lit(0.0))).alias("_gl"),
        F.avg(F.coalesce("est", F.lit(0.0)) - pnl).alias("slippage_gap"), deepest.alias("_dd"),
        F.min(F.struct("closed_us", "trade_id")).alias("_first"),
    )
    return agg.select(
        key, "trade_count", "total_pnl",
        F.when(F.col("_w") + F.col("_l") > 0, F.col("_w") / (F.col("_w") + F.col("_l"))).alias("win_rate"),
        sharpe(F.col("trade_count"), F.col("_mean"), F.col("_sd")).alias("sharpe"),
        F.when(F.col("_gl") > 0, F.col("_gp") / F.col("_gl")).when(F.col("_gp") > 0, F.col("_gp")).alias("profit_factor"),
        "slippage_gap", F.coalesce("_dd.d", F.lit(0.0)).alias("max_drawdown"),
        F.coalesce("_dd.peak_trade_id", "_first.trade_id").alias("from_trade_id"),
        F.coalesce(-F.col("_dd.t"), F.col("_first.trade_id")).alias("to_trade_id"),
    )


def backtest_summary(trades: DataFrame, key: str, capital: float = 2000.0, recent: int | None = None, minimum: int = 10, slice_us: int = 180 * DAY) -> DataFrame:
    """Sharpe, drawdown on capital and profit of each group's trades, or of its ``recent`` latest ones."""
    enough = trades.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).select(key)
    last = top_per_key(trades, key, [F.desc("closed_us"), F.desc("trade_id")], recent) if recent else trades
    rows, order = last.join(enough, key, "left_semi").select(key, "closed_us", "trade_id", "pnl"), ["closed_us", "trade_id"]
    slice_us = fit_width(rows, key, "closed_us", slice_us)
    curve = running(rows, key, order, "closed_us", slice_us, {"_e": ("sum", F.col("pnl"))}).withColumn("_e", capital + F.col("_e"))
    curve = running(curve, key, order, "closed_us", slice_us, {"_p": ("max", F.col("_e"))}).withColumn("_p", F.greatest(F.lit(capital), F.col("_p")))
    return curve.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"),
        sharpe(F.count(F.lit(1)), F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe"),
        F.greatest(F.lit(0.0), F.max((F.col("_p") - F.col("_e")) / F.col("_p"))).alias("max_drawdown"),
        F.sum("pnl").alias("net_profit"),
        F.lit(0.125).alias("recommended_alpha"),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row aggregates with different columns into one row."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def readiness(settled: DataFrame, as_of_us: int, target_trades: int = 100, target_days: int = 14) -> DataFrame:
    agg = settled.agg(
        F.count(F.lit(1)).alias("paper_trades"), F.min("closed_us").alias("_first"),
        F.count_if(F.col("pnl") > 0).alias("_w"), F.count_if(F.col("pnl") < 0).alias("_l"),
    )
    days = F.coalesce(F.greatest(F.lit(0), F.floor((F.lit(as_of_us) - F.col("_first")) / DAY)), F.lit(0)).cast("long")
    rate = F.when(F.col("_w") + F.col("_l") > 0, F.col("_w") / (F.col("_w") + F.col("_l")))
    out = agg.withColumn("running_days", days).withColumn("win_rate", rate)
    ready = (F.col("paper_trades") >= target_trades) & (F.col("running_days") >= target_days) & F.coalesce(F.col("win_rate") > 0.55, F.lit(False))
    return out.withColumn("is_ready", ready).drop("_first", "_w", "_l")


def readiness_verdict(
    executions: DataFrame, settled: DataFrame, samples: DataFrame, trades_needed: int = 100, win_rate_needed: float = 0.55, ev_needed: float = 0.0,
    primary: tuple[int, int] = (500, 10), fallback: tuple[int, int] = (50, 3),
) -> DataFrame:
    """Multi-threshold verdict with the price-impact mode (primary, fallback or accumulating)."""
    e = executions.agg(F.count_if((F.col("mode") == "PAPER") & (F.col("accepted") == 1)).alias("trade_count"))
    s = settled.agg(
        (F.count_if(F.col("pnl") > 0) / F.nullif(F.count_if(F.col("pnl") != 0), F.lit(0))).alias("win_rate"), F.avg("est").alias("avg_ev"),
    )
    k = samples.agg(F.count(F.lit(1)).alias("impact_samples"), F.countDistinct("asset_id").alias("impact_assets"))
    row = one_row(e, s, k)
    at = lambda t: (F.col("impact_samples") >= t[0]) & (F.col("impact_assets") >= t[1])
    mode = F.when(at(primary), "primary").when(at(fallback), "fallback").otherwise("accumulating")
    ok = [
        F.col("trade_count") >= trades_needed, F.coalesce(F.col("win_rate") >= win_rate_needed, F.lit(False)),
        F.coalesce(F.col("avg_ev") > ev_needed, F.lit(False)),
    ]
    return row.withColumn("impact_mode", mode).withColumn("is_ready", ok[0] & ok[1] & ok[2] & (F.col("impact_mode") != "accumulating"))


def tick_pnl(trades: DataFrame, slice_us: int = DAY) -> DataFrame:
    """PnL of each trade against the previous price of its asset (first trade of an asset has none)."""
    slice_us = fit_width(trades, "asset_id", "ts_us", slice_us)
    stepped = previous_row(trades, "asset_id", ["ts_us", "event_id"], "ts_us", slice_us, {"prev_price": F.col("price")})
    size = F.greatest(F.coalesce("size", F.lit(25.0)), F.lit(1.0))
    return stepped.filter("prev_price is not null").withColumn("pnl", (F.col("price") - F.col("prev_price")) * size).withColumn(
        "direction", F.when(F.col("price") >= 0.5, "YES").otherwise("NO")
    )


def hybrid_rows(open_positions: DataFrame, marks: DataFrame, closed: DataFrame) -> DataFrame:
    """Marked open positions and closed trades in one table."""
    size = F.when(F.col("signed_usd") != 0, F.abs("signed_usd")).otherwise(50.0)
    o = open_positions.join(marks, "market_id", "left").withColumn("mark", F.coalesce("mark", F.lit(0.5)))
    gain = F.when(F.col("side") == "YES", F.col("mark") - 0.5).otherwise(0.5 - F.col("mark")) * size
    open_rows = o.select(
        F.concat(F.lit("open-"), F.col("position_id").cast("string")).alias("row_id"), "market_id", F.lit("open").alias("status"),
        F.col("side").alias("direction"), F.lit(0.0).alias("realized"), gain.alias("unrealized"), F.col("mark").alias("mark_price"), F.col("opened_us").alias("updated_us"),
    )
    closed_rows = closed.select(
        F.col("trade_id").cast("string").alias("row_id"), "market_id", F.lit("closed").alias("status"), "direction",
        F.col("pnl").alias("realized"), F.lit(0.0).alias("unrealized"), F.col("exit_price").alias("mark_price"), F.col("closed_us").alias("updated_us"),
    )
    return open_rows.unionByName(closed_rows)


def live_report(rows: DataFrame, link_counts: DataFrame) -> DataFrame:
    """One-row report with link hit rates and findings; ``link_counts`` carries mapped and unresolved totals."""
    a = rows.agg(
        F.count_if(F.col("status") == "open").alias("open_trades"), F.count_if(F.col("status") == "closed").alias("closed_trades"),
        F.sum("realized").alias("realized_total"), F.sum("unrealized").alias("unrealized_total"), F.countDistinct("market_id").alias("unique_markets"),
    )
    c = F.col
    out = one_row(a, link_counts)
    total = F.greatest(F.lit(1), c("mapped") + c("unresolved"))
    out = out.withColumn("hit_rate", c("mapped") / total).withColumn("fallback_rate", c("unresolved") / total)
    notes = F.array_compact(F.array(
        F.when(c("fallback_rate") > 0.5, "many_fallback_links"), F.when((c("open_trades") > 0) & (c("unrealized_total") < 0), "unrealized_loss"),
        F.when(c("unresolved") > 0, "unresolved_links"),
    ))
    return out.withColumn("net_total", c("realized_total") + c("unrealized_total")).withColumn(
        "findings", F.when(F.size(notes) == 0, F.array(F.lit("healthy"))).otherwise(notes)
    )
