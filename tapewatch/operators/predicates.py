"""Row predicates, classifiers and filters. Every one is a column expression over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import fixed as X
from tapewatch.operators.sequence import DAY, US

# Order states that are not fills.
UNFILLED_STATES = ["OPEN", "PENDING", "PLACED", "ORDER_PLACED", "CANCELLED", "CANCELED"]


def has_any(text: Column, words: list[str]) -> Column:
    """True when ``text`` contains one of the (plain, letters-digits-hyphen) words."""
    return text.rlike("|".join(words))


def is_filled(status: Column) -> Column:
    return ~F.upper(F.coalesce(status, F.lit(""))).isin(UNFILLED_STATES)


def filled_only(trades: DataFrame) -> DataFrame:
    return trades.filter(is_filled(F.col("status")))


def unfilled_evidence(trades: DataFrame) -> DataFrame:
    """Rows that must not count as trade evidence."""
    return trades.filter(~is_filled(F.col("status")))


def reject_reason(wallet: str = "wallet", usd: str = "usd", tx: str = "tx_hash") -> Column:
    """First quality rule a fill breaks; null for a good fill."""
    return (
        F.when(F.coalesce(F.col(wallet), F.lit("")) == "", "no_wallet")
        .when(F.coalesce(F.col(usd), F.lit(0.0)) <= 0, "no_value")
        .when(F.coalesce(F.col(tx), F.lit("")) == "", "no_tx_hash")
    )


def normalise_time(raw: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text to epoch microseconds; null when unreadable."""
    text = F.trim(raw)
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.cast("double"))
    seconds = F.when(number > 10_000_000_000, number / 1000).otherwise(number)
    from_number = F.round(seconds * 1000).cast("long") * 1000
    iso = F.unix_micros(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)))
    return F.when(number.isNotNull(), from_number).otherwise(iso)


def fast_market(as_of_us: int) -> Column:
    """Five-minute up/down market with some volume, ending within 1 to 35 minutes."""
    slug, question = F.lower("slug"), F.lower("question")
    named = (
        has_any(slug, X.FAST_MARKET_WORDS)
        | (has_any(slug, ["bitcoin", "btc"]) & has_any(slug, ["up", "down"]))
        | (question.contains("bitcoin") & has_any(question, ["5 minute", "5-min", "5m"]))
    )
    left = (F.col("end_us") - as_of_us) / US
    return named & (F.col("volume") >= 100.0) & left.between(60, 2100)


def short_event_market(as_of_us: int) -> Column:
    """Open, non-algorithmic, non-sports market ending in 3 to 30 days with an undecided price."""
    days = (F.col("end_us") - as_of_us) / DAY
    bid = F.col("best_bid")
    return (
        ~F.col("closed")
        & ~has_any(F.lower("slug"), X.SHORT_EVENT_EXCLUDED_WORDS)
        & ~has_any(F.lower("category"), X.SPORTS_CATEGORIES)
        & (F.col("volume") >= 500.0)
        & days.between(3, 30)
        & (bid.isNull() | ((bid < 0.99) & (bid > 0.01)))
    )


def sports_market(as_of_us: int, variant: str = "radar") -> Column:
    """Live sports market by category or slug; ``variant`` picks the word lists."""
    slug, cat = F.lower("slug"), F.lower("category")
    arb = variant == "arb"
    by_category = has_any(cat, X.ARB_SPORTS_CATEGORIES if arb else X.SPORTS_CATEGORIES)
    by_slug = has_any(slug, X.ARB_SPORTS_SLUG_WORDS if arb else X.SPORTS_SLUG_WORDS)
    vetoed = by_slug & ~by_category & has_any(slug, X.SPORTS_GUARD_WORDS)
    soon = F.col("end_us").isNull() | (F.col("end_us") - as_of_us <= 45 * DAY)
    extra = F.col("active") if arb else ~has_any(slug, X.SEASON_WORDS)
    return extra & (by_category | by_slug) & ~vetoed & soon


def sports_rejections(as_of_us: int) -> Column:
    """All reasons a market is not a live sports market, as an array (null when accepted)."""
    slug, cat = F.lower("slug"), F.lower("category")
    by_category, by_slug = has_any(cat, X.SPORTS_CATEGORIES), has_any(slug, X.SPORTS_SLUG_WORDS)
    main = (
        F.when(has_any(slug, X.SEASON_WORDS), "season_kw")
        .when(by_slug & ~by_category & has_any(slug, X.SPORTS_GUARD_WORDS), "pol_guard")
        .when(by_slug & ~by_category, "slug_only")
        .when(by_category, "category_only")
    )
    state = F.when(~F.col("active"), "inactive").when(F.col("end_us") - as_of_us > 45 * DAY, "expiry>45d")
    return F.when(~sports_market(as_of_us), F.array_compact(F.array(main, state)))


def political_words(slug: Column) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in X.POLITICAL_WORDS]), lambda w: F.contains(slug, w))


def political_markets(markets: DataFrame) -> DataFrame:
    """Political markets with their keywords and the category of the first mapped keyword."""
    slug = F.lower("slug")
    lookup = F.create_map(*[F.lit(x) for kv in X.POLITICAL_CATEGORY.items() for x in kv])
    kept = markets.filter(
        ~has_any(slug, X.POLITICAL_EXCLUDED_WORDS)
        & (F.col("volume") >= 5000)
        & (F.coalesce("best_bid", F.lit(0.5)) < 0.99)
        & (F.coalesce("best_bid", F.lit(0.5)) > 0.01)
        & has_any(slug, X.POLITICAL_WORDS)
    )
    first = F.element_at(
        F.filter(F.transform("keywords", lambda w: F.element_at(lookup, w)), lambda c: c.isNotNull()), 1
    )
    tagged = kept.withColumn("keywords", political_words(slug))
    return tagged.withColumn(
        "political_category",
        F.coalesce(F.when(F.exists("keywords", lambda w: F.element_at(lookup, w).isNotNull()), first), F.lit("OTHER")),
    )


def tier_of(as_of_us: int) -> Column:
    slug, cat = F.lower("slug"), F.lower("category")
    left = F.coalesce((F.col("end_us") - as_of_us) / US, F.lit(float("inf")))
    fast = has_any(slug, X.TIER_FAST_WORDS)
    return (
        F.when(fast & (left <= 86400), "t1")
        .when(has_any(cat, X.TIER_SPORTS_WORDS) & (left <= 172800), "t5")
        .when(~fast & (left > 172800), "t2")
        .otherwise("t3")
    )


def resolution_risk(slug: Column) -> Column:
    slug = F.lower(slug)
    return (
        F.when(has_any(slug, X.LOW_RISK_WORDS), "LOW")
        .when(has_any(slug, X.HIGH_RISK_WORDS), "HIGH")
        .otherwise("MEDIUM")
    )


def market_kind(
    markets: DataFrame, trades: DataFrame, as_of_us: int, lookback_us: int = 300 * US, wide_spread: float = 0.85
) -> DataFrame:
    """Order-book market when it traded recently; otherwise automated when the spread is wide."""
    recent = (
        trades.filter((F.col("ts_us") >= as_of_us - lookback_us) & (F.col("ts_us") <= as_of_us))
        .select("market_id").distinct().withColumn("_traded", F.lit(True))
    )
    wide = F.coalesce(F.col("best_ask") - F.col("best_bid") > wide_spread, F.lit(False))
    joined = markets.join(recent, "market_id", "left")
    kind = F.when(F.col("_traded"), "CLOB").when(wide, "AMM").otherwise("CLOB_QUIET")
    eligible = (F.col("_traded").isNotNull() | ~wide) & F.col("best_ask").isNotNull()
    return joined.withColumn("kind", kind).withColumn("best_ask_eligible", eligible).drop("_traded")


def quote_price(bid: Column, ask: Column, last: Column, max_spread: float = 0.10) -> Column:
    """Mid of a tight book, else a last trade that is not the 0.5 placeholder, else null."""
    return F.when(F.round(ask - bid, 6) <= max_spread, (bid + ask) / 2).when(last.isNotNull() & (last != 0.5), last)


def time_weight(end_us: Column, as_of_us: int) -> Column:
    hours = F.greatest(F.lit(0.0), (end_us - as_of_us) / (3600.0 * US))
    return F.when(hours < 6, 1.0).when(hours < 24, 0.85).when(hours < 72, 0.65).when(hours < 168, 0.45).otherwise(0.30)


def fee_filter(tokens: DataFrame, fees: DataFrame, max_bps: int = 300) -> DataFrame:
    """Tokens without a fee above ``max_bps``; unknown fees pass."""
    return tokens.join(fees, "token_id", "left").filter(F.coalesce("fee_bps", F.lit(0)) <= max_bps)


def settlement_prices(prices: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last price per key, snapped to 1 or 0 when nearly decided."""
    last = prices.groupBy(key).agg(F.max_by("price", F.struct(*order)).alias("last_price"))
    snapped = F.when(F.col("last_price") >= 0.95, 1.0).when(F.col("last_price") <= 0.05, 0.0).otherwise(F.col("last_price"))
    return last.withColumn("settlement_price", snapped)


PERIOD_DAYS = {"1d": 1, "7d": 7, "30d": 30}


def in_period(ts_us: Column, period: str, as_of_us: int) -> Column:
    days = PERIOD_DAYS.get(period.lower())
    return F.lit(True) if days is None else ts_us >= as_of_us - days * DAY


def outcome_is(pnl: Column, status: str) -> Column:
    return {"win": pnl > 0, "loss": pnl < 0}.get(status, F.lit(True))


def funding_risk(label: Column) -> Column:
    label = F.lower(label)
    return F.when(has_any(label, X.MIXER_WORDS), "MIXER").when(has_any(label, X.EXCHANGE_WORDS), "CEX_HOT_WALLET").otherwise("NORMAL")


def artifact_violation(allowed: list[str]) -> Column:
    """First contract rule an artifact row (source, timestamp, version) breaks; null when fine."""
    source = F.trim(F.coalesce("source", F.lit("")))
    return (
        F.when(source == "", "missing_source")
        .when(~source.isin(allowed), "source_not_allowed")
        .when(has_any(F.lower(source), X.BLOCKED_SOURCE_MARKERS), "source_blocked")
        .when(F.trim(F.coalesce("timestamp", F.lit(""))) == "", "missing_timestamp")
        .when(F.trim(F.coalesce("version", F.lit(""))) == "", "missing_version")
    )


def macro_bypass(source: Column, scrubbed: Column) -> Column:
    """True for an unscrubbed candidate from a macro, harvested or raw source."""
    return has_any(F.upper(F.coalesce(source, F.lit(""))), ["MACRO", "HARVEST", "RAW"]) & ~scrubbed
