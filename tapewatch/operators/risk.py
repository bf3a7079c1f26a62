"""Correlated exposure, cluster caps and sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("market_a", "market_b", "rho").unionByName(
        edges.select(F.col("market_b").alias("market_a"), F.col("market_a").alias("market_b"), "rho")
    ).groupBy("market_a", "market_b").agg(F.max("rho").alias("rho"))


def max_abs_rho(edges: DataFrame, peers: DataFrame) -> DataFrame:
    """Largest |rho| of each market against its listed peers (market_id, peer)."""
    e = both_ways(edges).select(F.col("market_a").alias("market_id"), F.col("market_b").alias("peer"), "rho")
    return peers.join(e, ["market_id", "peer"]).groupBy("market_id").agg(F.max(F.abs("rho")).alias("max_rho"))


def largest_cluster(portfolio: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cluster with the largest absolute net notional."""
    net = portfolio.join(clusters.select("market_id", "cluster_id"), "market_id").groupBy("cluster_id").agg(F.sum("signed_usd").alias("net_usd"))
    return net.orderBy(F.desc(F.abs("net_usd")), "cluster_id").limit(1)


def exposure_verdicts(
    proposals: DataFrame,
    portfolio: DataFrame,
    clusters: DataFrame,
    anchors: DataFrame,
    edges: DataFrame,
    capital: float,
    cap_share: float = 0.25,
    unknown_share: float = 0.05,
) -> DataFrame:
    """Allow or reject each proposed trade by its cluster's correlation-weighted net exposure.

    A position's correlation to the cluster anchor comes from the edge table, else from the
    cluster semantics (same cluster: plus or minus one by direction against the proposal's), else
    one. Positions are summed per (cluster, market) before proposals join them.
    """
    c = F.col
    cap, unknown_cap = abs(capital) * cap_share, abs(capital) * unknown_share
    known = clusters.select("market_id", "cluster_id", F.coalesce("internal_direction", F.lit(1)).alias("market_dir"))
    held = portfolio.groupBy("market_id").agg(F.sum("signed_usd").alias("held"))
    rho = both_ways(edges)
    p = (
        proposals.join(known, "market_id", "left").join(held, "market_id", "left")
        .withColumn("held", F.coalesce("held", F.lit(0.0))).withColumn("target_dir", F.coalesce("market_dir", F.lit(1)))
        .join(anchors, "cluster_id", "left")
    )
    # Net exposure of a cluster for a proposal splits into: the sum over positions whose weight does
    # not depend on the proposal, and, for positions without an edge to the proposal's market that
    # is also their reference, the semantic weight. Only the anchor market is such a reference.
    pos = held.withColumnRenamed("held", "signed_usd").join(known, "market_id").join(anchors, "cluster_id", "left").withColumn("ref", F.coalesce("anchor", "market_id"))
    e = rho.select(c("market_a").alias("market_id"), c("market_b").alias("ref"), c("rho").alias("edge_rho"))
    pos = pos.join(e, ["market_id", "ref"], "left")
    own = c("market_id") == c("ref")
    fixed = F.when(own, 1.0).otherwise(F.coalesce("edge_rho", F.lit(1.0)))
    free = ~own & c("edge_rho").isNull()
    sums = pos.groupBy("cluster_id").agg(
        F.sum(c("signed_usd") * F.when(free, 0.0).otherwise(fixed)).alias("net_fixed"),
        F.sum(F.when(free, c("signed_usd")).otherwise(0.0)).alias("net_free"),
        F.sum(F.when(free, F.abs("signed_usd")).otherwise(0.0)).alias("gross_free"),
    )
    q = p.join(sums, "cluster_id", "left").na.fill(0.0, ["net_fixed", "net_free", "gross_free"])
    # Against the anchor itself every free position uses the semantic weight +-1 by direction.
    is_anchor = F.coalesce(c("market_id") == c("anchor"), F.lit(False))
    before = c("net_fixed") + F.when(is_anchor, c("gross_free") * c("target_dir")).otherwise(c("net_free"))
    pe = rho.select(c("market_a").alias("market_id"), c("market_b").alias("anchor"), c("rho").alias("own_rho"))
    q = q.join(pe, ["market_id", "anchor"], "left")
    weight = F.when(is_anchor | c("anchor").isNull(), 1.0).otherwise(F.coalesce("own_rho", F.lit(1.0)))
    q = q.withColumn("net_before", before).withColumn("net_after", c("net_before") + c("proposed_usd") * weight)
    unknown = c("cluster_id").isNull()
    reason = (
        F.when(unknown & (F.abs(c("held") + c("proposed_usd")) > unknown_cap + 1e-9), "UNKNOWN_CLUSTER_5PCT_CAP")
        .when(unknown, "OK")
        .when(F.abs("net_after") < F.abs("net_before") - 1e-12, "HEDGE_REDUCES_ABS_NET_DELTA")
        .when(F.abs("net_after") > cap + 1e-9, "CLUSTER_EXPOSURE_CAP")
        .otherwise("OK")
    )
    return q.select(
        "proposal_id", "market_id", F.coalesce("cluster_id", F.lit("UNKNOWN_CLUSTER")).alias("cluster_id"), "net_before", "net_after",
        reason.alias("reason"),
    ).withColumn("allowed", c("reason").isin("OK", "HEDGE_REDUCES_ABS_NET_DELTA"))


def shared_kelly(
    proposals: DataFrame, inventory: DataFrame, fallback_rho: float = 0.95, threshold: float = 0.85, budget: float = 0.25
) -> DataFrame:
    """Kelly fraction after sharing the budget with correlated holdings of the same cluster."""
    used = inventory.groupBy("cluster_id").agg(F.sum("kelly").alias("used"))
    j = proposals.join(used, "cluster_id", "left")
    rho = F.coalesce("rho", F.lit(fallback_rho))
    left = F.greatest(F.lit(0.0), budget - F.col("used")) / 2
    free = F.col("used").isNull() | (rho < threshold)
    return j.withColumn("kelly_shared", F.when(free, F.col("kelly")).otherwise(F.least("kelly", left)))


def committee(scores: DataFrame, key: str) -> DataFrame:
    """Mean committee score and disagreement per decision."""
    return scores.groupBy(key).agg(F.avg("score").alias("committee_score"), (F.max("score") - F.min("score")).alias("disagreement"))
