"""Event series: detection, ladder checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators import predicates as P
from tapewatch.operators import scalars as S
from tapewatch.operators.sequence import DAY, previous_row


def series_members(markets: DataFrame) -> DataFrame:
    """Markets tagged with their series: rolling windows by trailing timestamp, ladders by deadline (two members or more)."""
    slug = F.lower("slug")
    stamp = S.window_stamp(slug)
    ladder = S.deadline_prefix(slug)
    tagged = markets.filter(slug != "").select(
        "market_id", slug.alias("slug"), "end_us", F.coalesce("best_bid", F.lit(0.5)).alias("prob"), stamp.alias("window_ts"),
        F.when(stamp > 0, F.regexp_replace(S.rolling_prefix(slug), "^-+|-+$", "")).when((ladder != "") & (ladder != slug), F.regexp_replace(ladder, "^-+|-+$", "")).alias("series_id"),
        F.when(stamp > 0, "ROLLING_WINDOW").otherwise("DEADLINE_LADDER").alias("series_type"),
    ).filter("series_id is not null")
    sizes = tagged.groupBy("series_id", "series_type").agg(F.count(F.lit(1)).alias("members"))
    kept = sizes.filter((F.col("series_type") == "ROLLING_WINDOW") | (F.col("members") >= 2))
    position = F.when(F.col("series_type") == "ROLLING_WINDOW", F.col("window_ts")).otherwise(F.col("end_us"))
    return tagged.join(kept, ["series_id", "series_type"]).withColumn("position", position)


def series_list(members: DataFrame) -> DataFrame:
    """One row per series with its size, risk and first and last member."""
    at = F.struct("position", "slug")
    agg = members.groupBy("series_id", "series_type").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("slug", at).alias("first_slug"), F.max_by("slug", at).alias("last_slug")
    )
    risk = F.when(F.col("series_type") == "ROLLING_WINDOW", "LOW").otherwise(P.resolution_risk(F.col("series_id")))
    return agg.withColumn("risk", risk)


def related_series(series: DataFrame, topic_map: dict[str, list[str]]) -> DataFrame:
    """Series linked by a short manual topic map, as pairs."""
    pairs = F.create_map(*[x for k, v in topic_map.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return series.select("series_id", F.explode(F.coalesce(F.element_at(pairs, F.col("series_id")), F.array().cast("array<string>"))).alias("related_id"))


def ladder_violations(members: DataFrame, threshold: float = 0.02, slice_us: int = 30 * DAY) -> DataFrame:
    """Adjacent deadlines where the earlier one is priced above the later one by more than ``threshold``."""
    ladder = members.filter("series_type = 'DEADLINE_LADDER'")
    prev = {"earlier_slug": F.col("slug"), "_p": F.col("prob")}
    stepped = previous_row(ladder, "series_id", ["end_us", "slug"], "end_us", slice_us, prev)
    gap = F.col("_p") - F.col("prob")
    return stepped.withColumn("gap", gap).filter(F.col("gap") > threshold).select(
        "series_id", "earlier_slug", F.col("slug").alias("later_slug"), "gap", F.lit("EARLY_OVERPRICED").alias("direction")
    )
