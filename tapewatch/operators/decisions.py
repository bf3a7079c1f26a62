"""Probability, expected value, sizing and gate expressions over a signals table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def odds_update(prior: Column, likelihood_ratio: Column) -> Column:
    p = clip(prior, 1e-6, 1 - 1e-6)
    odds = p / (1 - p) * likelihood_ratio
    return odds / (1 + odds)


def posterior(prior: Column, z: Column, k_eff: Column, z_threshold: float = -4.0, entropy_ratio: float = 5.0, cap: float = 0.99) -> Column:
    """Posterior from the consensus ratio 2^k and a fixed ratio for an entropy shock."""
    entropy = F.when(z.isNotNull() & (z < z_threshold), F.lit(entropy_ratio)).otherwise(1.0)
    raw = odds_update(prior, entropy * F.pow(F.lit(2.0), k_eff))
    return F.least(F.lit(cap), F.greatest(F.lit(1e-6), raw))


def mean_log_odds(score: Column, extra: Column) -> Column:
    """Aggregate: geometric-mean likelihood ratio of source scores, clamped to [0.1, 20]; scores are held off 0 and 1."""
    n, score = F.count(score) + extra, clip(score, 1e-6, 1 - 1e-6)
    return F.when(n > 0, clip(F.exp(F.sum(F.log(score) - F.log(1.0 - score)) / n), 0.1, 20.0))


def consensus_posterior(ratio: Column, prior: float = 0.5) -> Column:
    p = F.lit(prior)
    return F.coalesce(clip(p * ratio / (p * ratio + (1.0 - p)), 0.001, 0.999), p)


def fractional_kelly(p: Column, price: Column, alpha: Column) -> Column:
    p = clip(p, 0.0, 1.0)
    b = (1 - price) / F.greatest(price, F.lit(1e-6))
    raw = (b * p - (1 - p)) / F.greatest(b, F.lit(1e-6))
    return F.greatest(F.lit(0.0), alpha * raw)


def net_value(p: Column, price: Column, fee: Column, slippage: Column, ask: Column, bid: Column) -> Column:
    """Expected value per share after fees, slippage and the bid/ask crossing cost."""
    entry = F.coalesce(ask, price)
    crossing = F.when(ask.isNotNull() & bid.isNotNull(), F.greatest(F.lit(0.0), ask - bid)).otherwise(0.0)
    return p * (1 - entry) - (1 - p) * entry - (fee + slippage + crossing)


def decide(df: DataFrame) -> DataFrame:
    """BUY or HOLD with posterior, expected value and Kelly fraction; heavy slippage always holds.

    Needs ``prior, likelihood_ratio, price, fee, slippage, ask, bid, alpha, allow_trade``.
    """
    c = F.col
    held = c("slippage") > 0.02
    post = F.when(held, c("prior")).otherwise(odds_update(c("prior"), c("likelihood_ratio")))
    ev = F.when(held, -1.0).otherwise(net_value(c("posterior"), c("price"), c("fee"), c("slippage"), c("ask"), c("bid")))
    kelly = F.when(held, 0.0).otherwise(fractional_kelly(c("posterior"), F.coalesce("ask", "price"), c("alpha")))
    return (
        df.withColumn("posterior", post).withColumn("ev_net", ev).withColumn("kelly", kelly)
        .withColumn("action", F.when(~held & c("allow_trade") & (c("ev_net") > 0) & (c("kelly") > 0), "BUY").otherwise("HOLD"))
    )


def size_after_friction(kelly: Column, fee: float, slippage: float) -> Column:
    return kelly * max(0.0, 1.0 - fee - slippage)


# Gate reason codes.
REASONS = {
    "latency": "NETWORK_LATENCY_BREAKER",
    "degraded_ev": "DEGRADED_AND_EV_NOT_ENOUGH",
    "degraded": "L2_TIMEOUT_DEGRADED",
    "slippage": "SLIPPAGE_TOLERANCE_EXCEEDED",
    "ev": "NON_POSITIVE_TIME_ADJUSTED_EV",
    "pass": "PASS",
}


def gate(
    df: DataFrame, ping_break_ms: float = 200.0, imbalance_multiplier: float = 3.0, tight_slippage: float = 0.01, degraded_kelly: float = 0.1
) -> DataFrame:
    """Execute, degrade or abort each signal row, with decayed probability, slippage and time-adjusted value."""
    c = F.col
    safe = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    slow = c("ping_ms") > ping_break_ms
    decayed = safe(safe(c("p_prior")) * F.exp(-c("gamma") * F.greatest(F.lit(0.0), c("delta_t_ms"))))
    slip = c("order_size") * c("kyle_lambda") * (1.0 + imbalance_multiplier * clip(c("imbalance"), 0.0, 1.0))
    out = (
        df.withColumn("p_adjusted", F.when(slow, c("p_prior")).otherwise(decayed))
        .withColumn("expected_slippage", F.when(slow, 0.0).otherwise(slip))
        .withColumn("p_avg", c("quote_price") + c("expected_slippage"))
    )
    ev = (
        c("p_adjusted") * c("payout") * c("order_size") - c("capital_in") - c("avg_entry_price") * c("order_size")
        - c("base_fee") * c("p_avg") * (1 - c("p_avg")) - c("gas_cost") - F.greatest(F.lit(0.0), c("p_avg") - c("quote_price"))
    )
    out = out.withColumn("ev_net", F.when(slow, -1.0).otherwise(ev))
    adj = c("ev_net") - c("capital_in") * c("daily_opp_cost") * c("days_to_resolution")
    out = out.withColumn("ev_time_adj", F.when(slow, -1.0).otherwise(adj))
    poor = c("ev_time_adj") <= c("min_ev")
    slipped = (c("slippage_tolerance") < tight_slippage) & (c("expected_slippage") > c("slippage_tolerance"))
    reason = (
        F.when(slow, REASONS["latency"])
        .when(c("degraded") & poor, REASONS["degraded_ev"])
        .when(c("degraded"), REASONS["degraded"])
        .when(slipped, REASONS["slippage"])
        .when(poor, REASONS["ev"])
        .otherwise(REASONS["pass"])
    )
    out = out.withColumn("gate_reason", reason)
    decision = (
        F.when(c("gate_reason") == REASONS["pass"], "EXECUTE").when(c("gate_reason") == REASONS["degraded"], "DEGRADE").otherwise("ABORT")
    )
    cap = F.when(slow, 0.0).when(c("degraded"), degraded_kelly).otherwise(c("kelly_cap"))
    return out.withColumn("decision", decision).withColumn("kelly_cap", cap)
