"""Trade-tape operators: sweeps, bursts, orders, entropy, price impact and flow imbalance.

Trades carry ``event_id, ts_us, wallet, market_id, asset_id, side, outcome, price, size, usd``;
``ts_us`` is event time in epoch microseconds and ``(ts_us, event_id)`` the total order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.lineage import cut_lineage
from tapewatch.operators.sequence import (
    DAY,
    HOUR,
    US,
    as_of,
    fit_width,
    islands,
    previous_row,
    range_frame,
    row_frame,
    running,
)

TIME_ORDER = ["ts_us", "event_id"]


def signed(side: Column = None) -> Column:
    side = F.col("side") if side is None else side
    return F.when(side == "BUY", F.lit(1)).otherwise(F.lit(-1))


def taker_sweeps(trades: DataFrame, gap_us: int = 10_000, slice_us: int = DAY) -> DataFrame:
    """Consecutive fills of a market by one taker on one side, at most ``gap_us`` apart."""
    starts = (
        (F.col("wallet") != F.col("_w"))
        | (F.col("side") != F.col("_s"))
        | (F.col("ts_us") - F.col("_t") > gap_us)
    )
    prev = {"_w": F.col("wallet"), "_s": F.col("side"), "_t": F.col("ts_us")}
    slice_us = fit_width(trades, "market_id", "ts_us", slice_us)
    marked = islands(trades, "market_id", TIME_ORDER, "ts_us", slice_us, prev, starts)
    return (
        marked.groupBy("market_id", "island")
        .agg(
            F.first("wallet").alias("wallet"),
            F.first("side").alias("side"),
            F.sum("size").alias("volume"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count(F.lit(1)).alias("child_count"),
        )
        .withColumn("first_event", F.col("island.event_id"))
        .drop("island")
    )


def cross_wallet_bursts(
    trades: DataFrame, gap_us: int = 50_000, min_size: int = 3, slice_us: int = DAY
) -> DataFrame:
    """Same-side chains of a market with enough trades and enough distinct takers."""
    starts = (F.col("side") != F.col("_s")) | (F.col("ts_us") - F.col("_t") > gap_us)
    prev = {"_s": F.col("side"), "_t": F.col("ts_us")}
    slice_us = fit_width(trades, "market_id", "ts_us", slice_us)
    marked = islands(trades, "market_id", TIME_ORDER, "ts_us", slice_us, prev, starts)
    per_wallet = marked.groupBy("market_id", "island", "wallet").agg(
        F.first("side").alias("side"),
        F.sum("size").alias("volume"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        per_wallet.groupBy("market_id", "island")
        .agg(
            F.first("side").alias("side"),
            F.sum("volume").alias("volume"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("n").alias("trade_count"),
            F.count(F.lit(1)).alias("members"),
        )
        .filter((F.col("trade_count") >= min_size) & (F.col("members") >= min_size))
        .withColumn("first_event", F.col("island.event_id"))
        .drop("island")
    )


def with_orders(trades: DataFrame, gap_us: int = 30 * US, slice_us: int = DAY) -> DataFrame:
    """Tag every fill with its order: fills of (wallet, market, side) at most ``gap_us`` apart."""
    keys = ["wallet", "market_id", "side"]
    return islands(
        trades, keys, TIME_ORDER, "ts_us", fit_width(trades, keys, "ts_us", slice_us),
        {"_t": F.col("ts_us")}, F.col("ts_us") - F.col("_t") > gap_us, "order_start",
    )


def order_type(fills: Column, span_us: Column) -> Column:
    return (
        F.when(fills == 1, "single")
        .when(span_us < 5 * US, "sweep")
        .when(fills >= 5, "twap")
        .otherwise("iceberg")
    )


def reconstruct_orders(
    trades: DataFrame, as_of_us: int, gap_us: int = 30 * US, slice_us: int = DAY
) -> DataFrame:
    """Order sessions with USD-weighted price, inferred type and completeness at ``as_of_us``."""
    keys = ["wallet", "market_id", "side"]
    agg = with_orders(trades, gap_us, slice_us).groupBy(*keys, "order_start").agg(
        F.sum("usd").alias("total_usd"),
        (F.sum(F.col("usd") * F.col("price")) / F.sum("usd")).alias("avg_price"),
        F.count(F.lit(1)).alias("fill_count"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    return agg.withColumn("order_type", order_type(F.col("fill_count"), F.col("last_us") - F.col("first_us"))).withColumn(
        "is_complete", F.col("last_us") < F.lit(as_of_us - gap_us)
    )


def shannon(buy: Column, sell: Column) -> Column:
    """Two-way Shannon entropy in bits; null without volume."""
    tot = buy + sell
    parts = [F.greatest(F.lit(1e-18), v / tot) for v in (buy, sell)]
    h = sum((-p * F.log2(p) for p in parts[1:]), -parts[0] * F.log2(parts[0]))
    return F.when(tot > 0, h)


def rolling_entropy(
    trades: DataFrame, window_us: int = 5 * US, min_events: int = 2, keys=("asset_id",)
) -> DataFrame:
    """Entropy of buy versus sell volume over the trailing window, per asset."""
    framed = range_frame(
        trades, list(keys), "ts_us", window_us,
        {
            "n_events": ("count", F.lit(1)),
            "buy_volume": ("sum", F.when(F.col("side") == "BUY", F.col("size")).otherwise(0.0)),
            "sell_volume": ("sum", F.when(F.col("side") == "SELL", F.col("size")).otherwise(0.0)),
        },
    )
    h = shannon(F.greatest("buy_volume", F.lit(0.0)), F.greatest("sell_volume", F.lit(0.0)))
    return framed.withColumn("entropy", F.when(F.col("n_events") >= min_events, h))


def entropy_zscore(
    entropies: DataFrame,
    keys=("asset_id",),
    history: int = 200,
    min_history: int = 12,
    slice_us: int = DAY,
) -> DataFrame:
    """z of the latest entropy step against the spread of the preceding entropy levels."""
    keys = list(keys)
    # Written, as running values read their rows twice: else the frames before would be made twice.
    defined = cut_lineage(entropies.filter(F.col("entropy").isNotNull()))
    stepped = running(
        defined, keys, TIME_ORDER, "ts_us", slice_us, {"_h": ("lag", F.col("entropy")), "_no": ("count", F.lit(1))}
    )
    framed = row_frame(
        stepped, keys, TIME_ORDER, "ts_us", slice_us, history - 1,
        {"n_prior": F.count("entropy"), "_var": F.var_samp("entropy")}, number="_no",
    )
    sigma = F.when(F.col("_var") > 1e-12, F.sqrt("_var")).otherwise(F.lit(1e-6))
    delta = F.col("entropy") - F.col("_h")
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), delta / sigma))
    ready = (F.col("n_prior") + 1 >= min_history) & (F.col("n_prior") >= 2)
    return framed.withColumn("delta_h", F.when(ready, delta)).withColumn("z", F.when(ready, z)).drop("_h", "_no", "_var")


def warmup_entropy(
    ticks: DataFrame,
    markers: DataFrame,
    window_us: int = 5 * US,
    healthy_us: int = 5 * US,
    min_events: int = 30,
    slice_us: int = DAY,
    key: str = "asset_id",
) -> DataFrame:
    """Rolling entropy with a lock after each reconnect marker.

    A marker empties the window; entropy stays null until the window holds ``min_events`` events
    or gaps (each capped at the window) add up to ``healthy_us``.
    """
    events = ticks.select(key, *TIME_ORDER, "side", "size", F.lit(0).alias("_m")).unionByName(
        markers.select(
            key, *TIME_ORDER,
            F.lit(None).cast("string").alias("side"), F.lit(0.0).alias("size"), F.lit(1).alias("_m"),
        )
    )
    sessions = running(events, key, TIME_ORDER, "ts_us", slice_us, {"session": ("sum", F.col("_m"))})
    keys = [key, "session"]
    live = sessions.filter("_m = 0").drop("_m")
    stepped = previous_row(live, keys, TIME_ORDER, "ts_us", slice_us, {"_t": F.col("ts_us")})
    stepped = stepped.withColumn(
        "_step", F.coalesce(F.least(F.col("ts_us") - F.col("_t"), F.lit(window_us)), F.lit(0))
    )
    span = running(stepped, keys, TIME_ORDER, "ts_us", slice_us, {"healthy_us": ("sum", F.col("_step"))})
    framed = rolling_entropy(cut_lineage(span), window_us, 2, keys)
    free = (F.col("session") == 0) | (F.col("n_events") >= min_events) | (F.col("healthy_us") >= healthy_us)
    opened = running(
        framed, keys, TIME_ORDER, "ts_us", slice_us, {"unlocked": ("max", free.cast("int"))}
    )
    return opened.withColumn(
        "entropy", F.when(F.col("unlocked") == 1, F.col("entropy"))
    ).drop("_t", "_step")


def trades_with_mid(trades: DataFrame, quotes: DataFrame, slice_us: int = DAY) -> DataFrame:
    """Latest quoted mid at or before each trade of the same asset (null before the first quote)."""
    book = quotes.filter((F.col("bid") > 0) & (F.col("ask") > F.col("bid"))).select(
        "asset_id", "ts_us", ((F.col("bid") + F.col("ask")) / 2).alias("mid")
    )
    return as_of(trades, book, "asset_id", "ts_us", "ts_us", ["mid"], "event_id", slice_us)


def price_impact(
    with_mid: DataFrame, ttl_us: int = 30 * US, slice_us: int = DAY, size: Column | None = None
) -> DataFrame:
    """|price change| per traded size against the previous trade, when both trades had a mid."""
    prev = {"_p": F.col("price"), "_m": F.col("mid"), "_t": F.col("ts_us")}
    stepped = previous_row(with_mid, "asset_id", TIME_ORDER, "ts_us", slice_us, prev)
    usable = (
        F.col("mid").isNotNull()
        & F.col("_m").isNotNull()
        & (F.col("_p") > 0)
        & (F.col("price") > 0)
        & (F.col("size") > 0)
        & (F.col("ts_us") - F.col("_t") <= ttl_us)
    )
    by = F.col("size") if size is None else F.greatest(size, F.lit(0.01))
    return (
        stepped.filter(usable)
        .withColumn("delta_price", F.abs(F.col("price") - F.col("_p")))
        .withColumn("lambda_obs", F.col("delta_price") / by)
        .drop(*prev)
    )


def price_impact_by_order(
    with_mid: DataFrame, order_gap_us: int = 30 * US, ttl_us: int = 30 * US, slice_us: int = DAY
) -> DataFrame:
    """Price impact divided by the USD total of the fill's reconstructed order."""
    keys = ["wallet", "market_id", "side", "order_start"]
    tagged = cut_lineage(with_orders(with_mid, order_gap_us, slice_us))
    totals = tagged.groupBy(*keys).agg(F.sum("usd").alias("order_usd"))
    sized = tagged.join(totals, keys).drop("order_start")
    return price_impact(sized, ttl_us, slice_us, F.col("order_usd"))


def book_impact(quotes: DataFrame, fills: DataFrame, ttl_us: int = 30 * US, slice_us: int = DAY) -> DataFrame:
    """|mid change| between consecutive books per size of the latest fill before the book."""
    book = quotes.filter((F.col("bid") > 0) & (F.col("ask") > F.col("bid"))).withColumn(
        "mid", (F.col("bid") + F.col("ask")) / 2
    )
    last = fills.select("asset_id", "ts_us", F.col("size").alias("trade_size"), F.col("ts_us").alias("trade_us"))
    tied = as_of(book, last, "asset_id", "ts_us", "ts_us", ["trade_size", "trade_us"], "event_id", slice_us)
    prev = {"_mid": F.col("mid")}
    stepped = previous_row(tied, "asset_id", TIME_ORDER, "ts_us", slice_us, prev)
    fresh = (F.col("ts_us") - F.col("trade_us") <= ttl_us) & (F.col("trade_size") > 0)
    return (
        stepped.filter(F.col("_mid").isNotNull() & fresh)
        .withColumn("delta_price", F.abs(F.col("mid") - F.col("_mid")))
        .withColumn("lambda_obs", F.col("delta_price") / F.col("trade_size"))
        .drop("_mid")
    )


def flow_shocks(
    lead_trades: DataFrame,
    lead_quotes: DataFrame,
    window_us: int = 100_000,
    min_notional: float = 500.0,
    imbalance: float = 0.60,
    gap_us: int = 5 * US,
    slice_us: int = HOUR,
) -> DataFrame:
    """One-sided flow shocks per coin with the book mid before and after.

    A trade arriving after a feed gap longer than ``gap_us`` only restarts the window.
    """
    valid = lead_trades.filter((F.col("price") > 0) & (F.col("size") > 0) & (F.col("ts_us") > 0)).withColumn(
        "notional", F.col("price") * F.col("size")
    )
    stepped = previous_row(valid, "coin", TIME_ORDER, "ts_us", slice_us, {"_t": F.col("ts_us")})
    kept = stepped.filter(F.col("_t").isNull() | (F.col("ts_us") - F.col("_t") <= gap_us)).drop("_t")
    framed = range_frame(
        kept, "coin", "ts_us", window_us,
        {
            "n_events": ("count", F.lit(1)),
            "total_usd": ("sum", F.col("notional")),
            "ofi": ("sum", F.col("notional") * signed()),
            "first_us": ("min", F.col("ts_us")),
        },
        valid.count(),
    )
    hits = framed.filter(
        (F.col("n_events") >= 2)
        & (F.col("total_usd") >= min_notional)
        & (F.abs("ofi") / F.greatest("total_usd", F.lit(1e-12)) >= imbalance)
    )
    hits = cut_lineage(hits)
    after = as_of(hits, lead_quotes.withColumnRenamed("mid", "price_after"), "coin", "ts_us", "ts_us", ["price_after"], "event_id", slice_us)
    both = as_of(after, lead_quotes.withColumnRenamed("mid", "price_before"), "coin", "first_us", "ts_us", ["price_before"], "event_id", slice_us)
    return both.withColumn("delta_us", F.col("ts_us") - F.col("first_us"))


def cooldown_triggers(
    trades: DataFrame, min_usd: float = 500.0, cooldown_us: int = 2 * US, slice_us: int = HOUR
) -> DataFrame:
    """Large trades, each silencing its market for ``cooldown_us`` (greedy in time order).

    A candidate that follows the previous candidate by at least the cooldown always fires, so
    quiet gaps cut a market into independent runs. A run longer than a slice is resolved from
    per-slice summaries: each slice maps the instant it becomes free to the instant the next
    slice does, and these maps are chained before the slices are replayed.
    """
    base = trades.filter(F.col("usd") >= min_usd).select("market_id", *TIME_ORDER, "usd")
    runs = islands(
        base, "market_id", TIME_ORDER, "ts_us", slice_us,
        {"_t": F.col("ts_us")}, F.col("ts_us") - F.col("_t") >= cooldown_us, "run",
    )
    width = max(slice_us, 2 * cooldown_us)
    cut = cut_lineage(
        runs.select(
            "market_id", *TIME_ORDER, "usd", F.col("run.ts_us").alias("run_us"), F.col("run.event_id").alias("run_event"),
            F.floor(F.col("ts_us") / width).cast("long").alias("part"),
            # Quiet markets share a task; a hot market is already cut by part.
            F.pmod(F.xxhash64("market_id"), F.lit(64)).alias("batch"),
        )
    )

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (market, run_us, run_event, part), group in pdf.groupby(["market_id", "run_us", "run_event", "part"]):
            ts = group["ts_us"].sort_values().to_numpy()
            lo = int(part) * width
            memo: dict[int, int] = {}
            for entry in sorted({lo, *(int(t) for t in ts if t < lo + cooldown_us), lo + cooldown_us}):
                path, end = [], entry
                i = int(ts.searchsorted(entry))
                while i < len(ts) and i not in memo:
                    path.append(i)
                    end = int(ts[i]) + cooldown_us
                    i = int(ts.searchsorted(end))
                end = memo.get(i, end)
                memo.update(dict.fromkeys(path, end))
                rows.append((market, run_us, run_event, part, entry, end))
        return pd.DataFrame(rows, columns=["market_id", "run_us", "run_event", "part", "free_from", "free_after"])

    # Only runs spanning several parts need the maps; one small row set per part remains.
    run_key = ["market_id", "run_us", "run_event"]
    spans = cut.groupBy(*run_key).agg(F.min("part").alias("_a"), F.max("part").alias("_b")).filter("_a < _b")
    long_runs = cut.join(spans.select(*run_key), run_key, "left_semi")
    maps = long_runs.groupBy("part", "batch").applyInPandas(
        exits, "market_id string, run_us long, run_event long, part long, free_from long, free_after long"
    )
    by_part = maps.groupBy("market_id", "run_us", "run_event", "part").agg(
        F.array_sort(F.collect_list(F.struct("free_from", "free_after"))).alias("steps")
    )
    # Chain the maps: fold parts in order, remembering the time each part becomes free.
    folded = by_part.groupBy("market_id", "run_us", "run_event").agg(
        F.array_sort(F.collect_list(F.struct("part", "steps"))).alias("parts")
    ).select(
        "market_id", "run_us", "run_event",
        F.expr(
            f"""aggregate(parts,
              named_struct('free', cast(0 as bigint), 'out', cast(array() as array<struct<part:bigint,free:bigint>>)),
              (acc, p) -> named_struct(
                'free', greatest(acc.free, coalesce(
                    element_at(filter(p.steps, s -> s.free_from >= greatest(acc.free, p.part * {width}L)), 1).free_after,
                    acc.free)),
                'out', concat(acc.out, array(named_struct('part', p.part, 'free', acc.free))))).out"""
        ).alias("frees"),
    )
    free = folded.select("market_id", "run_us", "run_event", F.explode("frees").alias("f")).select(
        "market_id", "run_us", "run_event", F.col("f.part").alias("part"), F.col("f.free").alias("free_from")
    )
    # The first run of a (market, part) may start before the part; later runs start inside it.
    heads = free.groupBy("market_id", "part").agg(F.min_by("free_from", "run_us").alias("free_from"))
    ready = cut.join(heads, ["market_id", "part"], "left")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["market_id", "ts_us", "event_id"])
        fired, market, at = [], None, 0
        starts = pdf["free_from"].fillna(0)
        for m, t, e, u, start in zip(pdf["market_id"], pdf["ts_us"], pdf["event_id"], pdf["usd"], starts):
            if m != market:
                market, at = m, int(start)
            if t >= at:
                at = t + cooldown_us
                fired.append((m, t, e, u))
        columns = list(zip(*fired)) if fired else [[], [], [], []]
        types = {"market_id": object, "ts_us": "int64", "event_id": "int64", "usd": "float64"}
        return pd.DataFrame({n: pd.Series(c, dtype=d) for (n, d), c in zip(types.items(), columns)})

    return ready.groupBy("part", "batch").applyInPandas(
        replay, "market_id string, ts_us long, event_id long, usd double"
    )


def gini(df: DataFrame, key: str, value: str) -> DataFrame:
    """Gini coefficient of ``value`` per key, clamped to [0, 1].

    Equal values are counted first; ranks come from a running count over slices of the value's
    logarithm, so a key with very many values is never sorted in one task.
    """
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_lg", F.log2(F.col(value) + 1.0)
    )
    ranked = running(counted, key, value, "_lg", 0.25, {"_upto": ("sum", F.col("_c"))})
    rank_sum = F.col("_c") * (F.col("_upto") - F.col("_c")) + F.col("_c") * (F.col("_c") + 1) / 2
    agg = ranked.groupBy(key).agg(
        F.sum("_c").alias("n"),
        F.sum(rank_sum * F.col(value)).alias("_weighted"),
        F.sum(F.col("_c") * F.col(value)).alias("_total"),
    )
    raw = 2 * F.col("_weighted") / (F.col("n") * F.col("_total")) - (F.col("n") + 1) / F.col("n")
    score = F.when(F.col("_total") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return agg.select(key, "n", score.alias("gini"))


def imbalance_index(parents: DataFrame, key: str = "wallet", volume: str = "volume") -> DataFrame:
    """|signed volume| over total volume per wallet."""
    tot = F.sum(volume)
    return parents.groupBy(key).agg(
        F.count(F.lit(1)).alias("parents"),
        (F.abs(F.sum(signed() * F.col(volume))) / F.when(tot == 0, 1.0).otherwise(tot)).alias("idi"),
    )


def burstiness(parents: DataFrame, slice_us: int = DAY) -> DataFrame:
    """Gini of the gaps between a wallet's consecutive parent orders."""
    stepped = previous_row(
        parents, "wallet", ["first_us", "first_event"], "first_us", slice_us, {"_last": F.col("last_us")}
    )
    gaps = stepped.filter(F.col("_last").isNotNull()).withColumn(
        "gap_us", F.greatest(F.lit(0), F.col("first_us") - F.col("_last"))
    )
    return gini(cut_lineage(gaps.select("wallet", "gap_us")), "wallet", "gap_us").select("wallet", F.col("gini").alias("burst"))


def wallet_labels(
    parents: DataFrame,
    min_parents: int = 8,
    taker_ratio: float = 0.8,
    idi_high: float = 0.8,
    idi_low: float = 0.3,
    taker_high: float = 0.7,
    taker_low: float = 0.2,
    burst_high: float = 0.8,
) -> DataFrame:
    """Four-way wallet label from parent count, imbalance, burstiness and taker ratio."""
    parents = cut_lineage(parents)
    feats = imbalance_index(parents).join(burstiness(parents), "wallet", "left").withColumn(
        "burst", F.coalesce("burst", F.lit(0.0))
    )
    taker = F.lit(taker_ratio)
    slicing = (F.col("idi") > idi_high) & (taker > taker_high) & (F.col("burst") > burst_high)
    neutral = (F.col("idi") < idi_low) & (taker < taker_low)
    few = F.col("parents") < min_parents
    return feats.withColumn(
        "label",
        F.when(few, "POTENTIAL_INSIDER")
        .when(slicing, "INSIDER_ALGO_SLICING")
        .when(neutral, "MARKET_MAKER_NOISE")
        .otherwise("UNCERTAIN_NOISE"),
    ).withColumn(
        "label_reason",
        F.when(few, "low_parent_count")
        .when(slicing, "idi_high_taker_high_burst_high")
        .when(neutral, "inventory_neutral_low_taker")
        .otherwise("ambiguous_middle_region"),
    )


def burst_labels(bursts: DataFrame) -> DataFrame:
    """Label of a cross-wallet burst: coordinated when it is substantial."""
    big = (F.col("trade_count") >= 3) & (F.col("members") >= 3) & (F.col("volume") > 0)
    return bursts.withColumn("label", F.when(big, "COORDINATED_SMURF").otherwise("UNCERTAIN_NOISE"))
