"""Signal decisions: entropy signals through consensus, price and gate to execution rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators import decisions as D
from tapewatch.operators import predicates as P

# Reasons decided before the gate.
FAST_TIER, FEW_SOURCES, NO_PRICE, DEGRADED_PREFIX = "T1_SHORT_CIRCUIT", "INSUFFICIENT_CONSENSUS", "NO_PRICE_DATA", "KELLY_DEGRADED:"

# Gate inputs of paper trading.
PAPER_INPUTS = {
    "payout": 1.0, "delta_t_ms": 150.0, "gamma": 0.001, "slippage_tolerance": 0.05, "min_ev": 0.0, "daily_opp_cost": 0.0008,
    "days_to_resolution": 3.0, "imbalance": 0.0, "ping_ms": 120.0, "base_fee": 0.0015, "kyle_lambda": 0.00001, "gas_cost": 0.0, "kelly_cap": 0.25, "capital_share": 1.0,
}


def signal_decisions(
    signals: DataFrame, sources: DataFrame, positions: DataFrame, min_z: float = 4.0, min_sources: int = 2, order_usd: float = 10.0, inputs: dict | None = None
) -> DataFrame:
    """One execution row per signal whose |z| reaches ``min_z``.

    ``signals`` carries ``signal_id, market_id, tier, z, wallet, bid, ask, last_price, end_us,
    signal_us, te_significant``; ``sources`` the number of qualified wallets per signal and the sum of their log-odds.
    The signals table is the only large input; sources and positions join on their keys.
    """
    c = F.col
    strong = signals.filter(F.abs("z") >= min_z)
    grouped = sources.select("signal_id", "n_sources", F.col("log_odds").alias("_log_odds"))
    held = positions.select("wallet", "market_id", F.col("avg_entry_price").alias("prev_entry"))
    j = (
        strong.join(grouped, "signal_id", "left").join(held, ["wallet", "market_id"], "left")
        .withColumn("n_sources", F.coalesce("n_sources", F.lit(0))).withColumn("_te", F.col("te_significant").cast("int"))
    )
    n = c("n_sources") + c("_te")
    ratio = F.when(n > 0, D.clip(F.exp(F.coalesce("_log_odds", F.lit(0.0)) / n), 0.1, 20.0))
    consensus = D.consensus_posterior(ratio)
    weight = F.when(c("end_us").isNull() | (c("end_us") <= c("signal_us")), 0.30).otherwise(P.time_weight(c("end_us"), c("signal_us")))
    j = j.withColumn("_quote", P.quote_price(c("bid"), c("ask"), c("last_price"))).withColumn("_consensus", consensus)
    early = (
        F.when(c("tier") == "t1", FAST_TIER)
        .when(n < min_sources, FEW_SOURCES)
        .when(c("_quote").isNull() | c("ask").isNull(), NO_PRICE)
    )
    j = j.withColumn("_early", early).withColumn("p_prior", F.when(c("tier") == "t5", 0.5 * weight).otherwise(c("_consensus")))
    ready = j.withColumn("quote_price", F.coalesce("_quote", F.lit(0.0))).withColumn("avg_entry_price", F.coalesce("ask", F.lit(0.0)))
    given = {**PAPER_INPUTS, **(inputs or {})}
    stake = order_usd * given.pop("capital_share")
    ready = ready.withColumn("order_size", F.lit(order_usd)).withColumn("capital_in", c("quote_price") * stake).withColumn("degraded", F.lit(False))
    ready = ready.select("*", *[F.lit(value).alias(name) for name, value in given.items()])
    g = D.gate(ready)
    gated = c("_early").isNull()
    reason = F.coalesce("_early", F.when(c("decision") == "DEGRADE", F.concat(F.lit(DEGRADED_PREFIX), "gate_reason")).otherwise(c("gate_reason")))
    shown = F.when(gated, c("p_prior")).when(c("_early") == NO_PRICE, c("_consensus")).otherwise(0.0)
    return g.select(
        "signal_id", "market_id", "tier", "z", "n_sources",
        (gated & (c("decision") != "ABORT")).cast("int").alias("accepted"), reason.alias("reason"), shown.alias("posterior"),
        F.when(gated, c("p_adjusted")).otherwise(0.0).alias("p_adj"), F.when(gated, c("order_size")).otherwise(0.0).alias("qty"),
        F.when(gated, c("ev_net")).otherwise(0.0).alias("ev_net"),
        F.when(gated, c("avg_entry_price")).when(c("_early") == NO_PRICE, F.coalesce("prev_entry", F.lit(0.0))).otherwise(0.0).alias("avg_entry_price"),
    )
