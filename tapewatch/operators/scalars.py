"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import fixed as X

WINDOW_SECONDS = 300


def safe_double(text: Column) -> Column:
    """Number from text; 'none', 'null', 'nan' and blanks are null."""
    t = F.lower(F.trim(text.cast("string")))
    cleaned = F.when(~t.isin("none", "null", "nan", ""), t)
    return F.when(cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([e][+-]?\d+)?$"), cleaned.cast("double"))


def first_usable(columns: list[str], available: list[str], usable) -> Column:
    picks = [usable(F.col(c)) for c in columns if c in available]
    return F.coalesce(*picks) if picks else F.lit(None)


def resolve_aliases(raw: DataFrame) -> DataFrame:
    """Canonical taker, side, size, market and outcome from whichever alias column is usable."""
    have = raw.columns
    address = lambda c: F.when(c.startswith("0x"), F.substring(F.lower(c), 1, 42))
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    size = F.abs(first_usable(["size", "amount", "matched_amount"], have, safe_double))
    side = F.upper(F.col("side"))
    sign = F.when(side.isin("BUY", "BUY_YES", "1"), 1).when(side.isin("SELL", "SELL_YES", "-1"), -1).otherwise(1)
    named = F.upper(first_usable(["outcome_side", "side_token", "bet"], have, text))
    outcome = (
        F.when(named.isin("YES", "Y", "BUY_YES"), "YES").when(named.isin("NO", "N", "BUY_NO"), "NO")
        .when(side.isin("SELL", "NO"), "NO").otherwise("YES")
    )
    return raw.select(
        *[c for c in have if c not in {"taker", "size", "market", "outcome_side"}],
        F.coalesce(first_usable(["taker", "taker_address", "trader", "address", "wallet"], have, address), F.lit("")).alias("taker"),
        sign.alias("side_sign"),
        F.coalesce(size, F.lit(0.0)).alias("size"),
        first_usable(["market", "market_id", "condition_id", "token_id", "asset_id"], have, text).alias("market"),
        outcome.alias("outcome_side"),
    )


def window_stamp(slug: Column) -> Column:
    """Trailing window timestamp of a slug, 0 when it has none."""
    digits = F.regexp_extract(slug, X.WINDOW_SUFFIX, 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("long"))


def rolling_prefix(slug: Column) -> Column:
    return F.regexp_replace(slug, X.WINDOW_SUFFIX, "")


def deadline_prefix(slug: Column) -> Column:
    """Slug without its month-and-day deadline."""
    return F.regexp_replace(F.regexp_replace(slug, "(?i)" + X.DEADLINE_SUFFIX, ""), "-+$", "")


def window_start(epoch_s: Column) -> Column:
    return (F.floor(epoch_s / WINDOW_SECONDS) * WINDOW_SECONDS).cast("long")


# Slug prefixes of the five-minute markets.
WINDOW_PREFIXES = ["btc-updown-5m", "eth-updown-5m", "sol-updown-5m"]


def window_slugs(starts: DataFrame, start: str, windows: int = 3, prefixes: list[str] | None = None) -> DataFrame:
    """Slugs of the current and following windows for every asset prefix."""
    each = starts.select(start, F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("_k"))
    each = each.select(start, "_k", F.explode(F.array(*[F.lit(p) for p in prefixes or WINDOW_PREFIXES])).alias("_name"))
    return each.select(start, F.concat_ws("-", "_name", (F.col(start) + F.col("_k") * WINDOW_SECONDS).cast("string")).alias("slug"))


def live_windows(slug: Column, current_window: Column) -> Column:
    """False for fast-market slugs more than one window old."""
    stale = slug.contains("updown-5m") & (window_stamp(slug) > 0) & (window_stamp(slug) < current_window - WINDOW_SECONDS)
    return ~stale


def payload_number(payload: Column, names: list[str]) -> Column:
    """First numeric JSON member among ``names``."""
    return F.coalesce(*[safe_double(F.get_json_object(payload, f"$.{n}")) for n in names])


def payload_amount(payload: Column) -> Column:
    return F.coalesce(payload_number(payload, ["size", "Size", "amount", "Amount"]), F.lit(0.0))


def entity_id(roots: Column, wallet: Column, prefix: str = "ve_") -> Column:
    """Stable id of a root set; a wallet without roots is its own entity."""
    clean = F.array_sort(F.array_distinct(F.transform(
        F.filter(F.coalesce(roots, F.array().cast("array<string>")), lambda r: r.startswith("0x")), lambda r: F.substring(F.lower(r), 1, 42)
    )))
    basis = F.when(F.size(clean) > 0, F.array_join(clean, "|")).otherwise(F.concat(F.lit("solo:"), F.substring(F.lower(wallet), 1, 42)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(basis, 256), 1, 16))


def direction(signed_usd: Column) -> Column:
    return F.when(signed_usd >= 0, 1).otherwise(-1)


# Evidence weight of an entity label, node colour of a wallet quality.
LABEL_WEIGHT = {"ALGO_SLICING": 0.75, "LONG_TERM_HOLDER": 0.55, "SMART_MONEY_QUANT": 0.65}
QUALITY_COLOR = {"tier1": "#22d3ee", "tier2": "#a78bfa", "whale": "#34d399", "degen": "#f87171", "unknown": "#94a3b8"}


def lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def label_weight(tag: Column) -> Column:
    return lookup(LABEL_WEIGHT, tag, 0.5)


def size_imbalance(bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    return F.when(total == 0, 0.0).otherwise((bid_size - ask_size) / total)


def spread_impact(spread: Column, depth: Column) -> Column:
    return F.when(depth <= 0, 0.0).otherwise(spread / depth)


def distribution_entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def merge_cluster_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Market cluster rows after newer semantics: the latest theme, direction and entities win whole."""
    fields = ["cluster_id", "internal_direction", "entities", "updated_us"]
    both = old.select("market_id", F.struct(*fields).alias("row"), F.lit(0).alias("_n")).unionByName(
        new.select("market_id", F.struct(*fields).alias("row"), F.lit(1).alias("_n"))
    )
    return both.groupBy("market_id").agg(F.max_by("row", F.struct("_n", F.col("row.updated_us"))).alias("row")).select("market_id", "row.*")


def behaviour_score(hour: Column, minute: Column, preflight: Column) -> Column:
    """Habit score from night activity, round minutes and preflight transactions."""
    raw = (
        0.45 * F.when(hour.between(1, 5), 1.0).otherwise(0.0)
        + 0.35 * F.when(minute % 5 == 0, 1.0).otherwise(0.3)
        + 0.2 * F.when(preflight, 1.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def bounded(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cognitive_scores(df: DataFrame) -> DataFrame:
    """Trust, reliability and event scores from graph trust, behaviour, funding risk and sentiment."""
    from tapewatch.operators.predicates import funding_risk

    risk = funding_risk(F.col("funding_label"))
    off = risk != "NORMAL"
    behaviour = behaviour_score(F.hour("seen_at"), F.minute("seen_at"), F.col("preflight"))
    graph = F.when(off, 0.0).otherwise(F.col("graph_trust"))
    trust = bounded(graph * F.when(off, 0.2).otherwise(1.0) + behaviour * F.when(off, 0.8).otherwise(0.4))
    return (
        df.withColumn("funding_risk", risk)
        .withColumn("behavior_score", behaviour)
        .withColumn("trust", trust)
        .withColumn("signal_reliability", bounded((F.col("trust") + F.col("sentiment")) / 2))
        .withColumn("external_event_score", bounded(F.col("sentiment") * 0.7 + F.col("trust") * 0.3))
    )
