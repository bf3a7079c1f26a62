"""Consensus clusters of wallets betting the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.graph import effective_wallets
from tapewatch.operators.sequence import DAY, US


def consensus_clusters(
    trades: DataFrame,
    reference: DataFrame,
    decay_per_sec: float = 1.0e-5,
    link_us: int = 2 * US,
    min_wallets: int = 3,
    min_usd: float = 5000.0,
    ref_share: float = 0.02,
    conflict_limit: float = 0.3,
    mode: str = "penalize",
    penalty: float = 0.25,
    min_net: float = 100.0,
    slice_us: int = DAY,
) -> DataFrame:
    """Every (market, direction) cluster with its effective size and the reason it was rejected, if any.

    ``trades`` are filled and carry ``outcome`` as direction; ``reference`` gives the liquidity
    value per market. The best accepted cluster has ``is_best``.
    """
    c = F.col
    keys = ["market_id", "outcome"]
    base = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("_a"), F.max("ts_us").alias("_b"), F.sum("usd").alias("total_usd")
    )
    sides = base.groupBy("market_id").agg(
        F.coalesce(F.sum(F.when(c("outcome") == "YES", c("total_usd"))), F.lit(0.0)).alias("yes_usd"),
        F.coalesce(F.sum(F.when(c("outcome") == "NO", c("total_usd"))), F.lit(0.0)).alias("no_usd"),
    )
    eff = effective_wallets(trades, keys, link_us, slice_us)
    j = (
        base.filter(c("n") >= 2).join(sides, "market_id").join(eff, keys).join(reference, "market_id", "left")
        .withColumn("threshold_usd", F.greatest(F.lit(min_usd), F.coalesce("ref_usd", F.lit(0.0)) * ref_share))
        .withColumn("w_time", F.exp(-decay_per_sec * (c("_b") - c("_a")) / float(US)))
        .withColumn("conflict", F.when(c("outcome") == "YES", c("no_usd")).otherwise(c("yes_usd")) / F.greatest(F.abs(c("yes_usd") - c("no_usd")), F.lit(min_net)))
    )
    clash = c("conflict") > conflict_limit
    reject = F.when(c("total_usd") < c("threshold_usd"), "below_notional_threshold").when(c("effective_wallets") < min_wallets, "below_wallet_count")
    if mode == "cancel":
        reject = reject.when(clash, "net_conviction_cancel")
    k = c("effective_wallets") * c("w_time") * F.when(clash, penalty).otherwise(1.0)
    out = j.withColumn("reject", reject).withColumn("k_eff", k)
    best = out.filter("reject is null").select(F.struct(c("k_eff"), *keys).alias("s")).agg(F.max("s").alias("_best")).withColumn("_one", F.lit(1))
    flagged = out.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one", "left")
    is_best = F.coalesce((c("_best.market_id") == c("market_id")) & (c("_best.outcome") == c("outcome")), F.lit(False))
    return flagged.withColumn("is_best", is_best).drop("_a", "_b", "_one", "_best")
