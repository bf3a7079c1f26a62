"""Discovery cycle: candidates to scrubbed, grouped and scored entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators import graph as G
from tapewatch.operators import wallets as A
from tapewatch.operators.lineage import cut_lineage
from tapewatch.operators.performance import one_row


def discovery_cycle(
    track_a: DataFrame, track_b: DataFrame, history: DataFrame, roots: DataFrame, previous: DataFrame, within_us: int, sync: float = 0.6, min_idi: float = 0.3, max_stake_share: float = 0.5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity rows, wallet rows and a one-row summary of one cycle.

    ``history`` carries ``wallet, side, usd, balance_before, ts_us, source``; ``previous`` the
    stored trust per entity. Candidates carry ``win_rate`` in the tracks.
    """
    candidates = A.merge_tracks(track_a, track_b)
    rates = track_a.select("wallet", "win_rate", F.lit(0).alias("track")).unionByName(track_b.select("wallet", "win_rate", F.lit(1).alias("track")))
    candidates = candidates.join(rates, ["wallet", "track"], "left").groupBy("wallet", "track", "discovery_source", "pnl").agg(F.max("win_rate").alias("win_rate"))
    scrubbed = cut_lineage(A.discovery_filter(candidates, history, min_idi, max_stake_share))
    quality = history.groupBy("wallet").agg(F.min("source").alias("_lo"), F.max("source").alias("_hi"), F.max("ts_us").alias("last_seen_us"))
    survivors = scrubbed.filter("drop_tag is null").join(quality, "wallet", "left").join(roots, "wallet", "left")
    survivors = survivors.withColumn(
        "source_quality",
        F.when(F.col("_lo").isNull(), "no_history_candidate_signal").when(F.col("_lo") != F.col("_hi"), "hybrid").otherwise(F.concat("_lo", F.lit("_only"))),
    )
    survivors = cut_lineage(survivors.drop("_lo", "_hi"))
    groups = G.sybil_groups(survivors.select("wallet", "roots"), history, within_us, sync)
    named = cut_lineage(survivors.join(groups.select("wallet", "entity_id"), "wallet"))
    entities = named.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("wallets"), F.avg(F.coalesce("win_rate", F.lit(0.0))).alias("avg_win_rate"), F.sum("sample_size").alias("sample_size")
    )
    tag = F.when(F.col("avg_win_rate") >= 0.7, "ALGO_SLICING").otherwise("LONG_TERM_HOLDER")
    entities = entities.withColumn("primary_tag", tag).join(previous.select("entity_id", F.col("trust_score").alias("_prev")), "entity_id", "left")
    entities = entities.withColumn("trust_score", A.trust_score(F.col("_prev"), F.col("avg_win_rate"), F.col("sample_size"), F.col("primary_tag"))).drop("_prev")
    wallets = named.select("wallet", "entity_id", "pnl", "win_rate", "discovery_source", "source_quality", "sample_size", "last_seen_us")
    n = F.count(F.lit(1))
    summary = one_row(
        scrubbed.agg(n.alias("fetched_candidates"), F.count_if(F.col("drop_tag").isNotNull()).alias("dropped")),
        named.agg(n.alias("survivors"), F.count_if(F.col("source_quality") == "hybrid").alias("hybrid")),
        entities.agg(n.alias("entities")),
    )
    return entities, wallets, summary
