"""Hot keys: results do not depend on slices, and no slice holds a hot key's rows."""

import random

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import joins
from tapewatch.operators import microstructure as M
from tapewatch.operators import wallets as A
from tapewatch.operators.sequence import HOUR, US, fit_width, numbered, previous_row, row_frame, running, with_slice
from tapewatch.sources import sinks as K


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of all trades in one market, one wallet dominating it."""
    rng = random.Random(11)
    rows = []
    for i in range(6000):
        m = "hot" if rng.random() < 0.66 else f"m{rng.randrange(40)}"
        w = "0x" + (("a" if rng.random() < 0.5 else rng.choice("bcdef")) * 40)
        rows.append((i, rng.randrange(0, 48 * 3600) * US + i, w, m, m, rng.choice(["BUY", "SELL"]), rng.choice(["YES", "NO"]), rng.randrange(1, 99) / 100, float(rng.randrange(1, 50))))
    df = spark.createDataFrame(rows, "event_id long, ts_us long, wallet string, market_id string, asset_id string, side string, outcome string, price double, size double")
    return df.withColumn("usd", F.round(F.col("price") * F.col("size"), 4)).cache()


def rows_of(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


WIDTHS = [HOUR // 2, 5 * HOUR, 10**15]


def same_for_all_widths(make):
    first, *rest = [rows_of(make(w)) for w in WIDTHS]
    assert first and all(r == first for r in rest)


def test_slices_bound_the_largest_group(hot):
    whole = hot.groupBy("market_id").count().agg(F.max("count")).head()[0]
    cut = with_slice(hot, "market_id", "ts_us", HOUR).groupBy("market_id", "_slice").count().agg(F.max("count")).head()[0]
    assert cut * 10 < whole


def test_previous_row_and_running(hot):
    same_for_all_widths(lambda w: previous_row(hot, "market_id", ["ts_us", "event_id"], "ts_us", w, {"p": F.col("price")}).select("event_id", "p").na.fill(-1.0))
    same_for_all_widths(
        lambda w: running(
            hot, "market_id", ["ts_us", "event_id"], "ts_us", w,
            {"s": ("sum", F.col("size")), "m": ("max", F.col("price")), "l": ("last", F.when(F.col("side") == "BUY", F.col("event_id"))), "n": ("count", F.lit(1))},
        ).select("event_id", "s", "m", F.coalesce("l", F.lit(-1)).alias("l"), "n")
    )


def test_row_numbers_and_row_frames(hot):
    n = numbered(hot, "market_id", ["ts_us", "event_id"], "ts_us", HOUR)
    per = n.groupBy("market_id").agg(F.max("rn").alias("m"), F.countDistinct("rn").alias("d"), F.count(F.lit(1)).alias("c"))
    assert per.filter("m <> c or d <> c").count() == 0
    make = lambda b: row_frame(hot, "market_id", ["ts_us", "event_id"], "ts_us", HOUR, 20, {"a": F.avg("price"), "c": F.count(F.lit(1))}, block=b).select("event_id", "a", "c").na.fill(-1.0)
    assert rows_of(make(20)) == rows_of(make(10**9))


def test_sweeps_bursts_and_orders(hot):
    gap = 60 * US
    same_for_all_widths(lambda w: M.taker_sweeps(hot, gap, w))
    same_for_all_widths(lambda w: M.cross_wallet_bursts(hot, gap, 3, w))
    same_for_all_widths(lambda w: M.reconstruct_orders(hot, 10**12, 300 * US, w).drop("order_start"))


def test_position_replay_matches_a_loop(hot):
    state = {}
    for r in hot.orderBy("ts_us", "event_id").collect():
        k = (r.wallet, r.market_id)
        if r.side == "BUY":
            q, a = state.get(k, (0.0, 0.0))
            state[k] = (q + r.size, (a * q + r.price * r.size) / (q + r.size))
        elif k in state and state[k][0] > 0:
            state[k] = (max(0.0, state[k][0] - r.size), state[k][1])
    got = {(r.wallet, r.market_id): (r.quantity, r.avg_entry_price) for r in A.replay_positions(hot, HOUR).collect()}
    assert set(got) == set(state)
    for k, (q, a) in state.items():
        assert got[k][0] == pytest.approx(q, abs=1e-6) and got[k][1] == pytest.approx(a, abs=1e-6)


def test_cooldown_matches_a_loop(hot):
    want, last = set(), {}
    for r in hot.filter("usd >= 5").orderBy("ts_us", "event_id").collect():
        if r.market_id not in last or r.ts_us - last[r.market_id] >= 600 * US:
            last[r.market_id] = r.ts_us
            want.add(r.event_id)
    for w in (3600 * US, 5 * 3600 * US):
        assert {r.event_id for r in M.cooldown_triggers(hot, 5.0, 600 * US, w).collect()} == want


def test_retention_above_the_window_limit_threshold(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id"))
    kept = K.keep_newest(df, ["k"], [F.desc("id")], 1440)
    assert kept.count() == 1440 and kept.agg(F.min("id")).head()[0] == 5000 - 1440


def test_fitted_slices_bound_a_hot_hour(spark):
    """A million rows of one key in one hour: no slice holds more than wanted, and null keys count as a key."""
    rows = spark.range(1_000_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.lit(None)).alias("market_id"), (F.col("id") * 3600).alias("ts_us"), F.col("id").alias("event_id"))
    width = fit_width(rows, "market_id", "ts_us", 24 * HOUR, rows=50_000)
    fullest = with_slice(rows, "market_id", "ts_us", width).groupBy("_key", "_slice").count().agg(F.max("count")).head()[0]
    assert fullest <= 50_000 and width > 1
    n = numbered(rows, "market_id", ["ts_us", "event_id"], "ts_us", width)
    assert sorted(tuple(r) for r in n.groupBy("market_id").agg(F.max("rn"), F.countDistinct("rn")).na.fill("-").collect()) == [("-", 100_000, 100_000), ("hot", 900_000, 900_000)]
    assert fit_width(rows.limit(0), "market_id", "ts_us", HOUR) == HOUR


def test_rows_are_shuffled_once(spark, hot):
    """The window's partitioning serves the join of carried values; only one row per slice travels besides."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        source = spark.createDataFrame([(1, 1, "a", 1.0)], "event_id long, ts_us long, market_id string, size double")
        plan = running(source, "market_id", ["ts_us", "event_id"], "ts_us", HOUR, {"s": ("sum", F.col("size"))})._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    join = plan.index("SortMergeJoin")
    rows_side = plan[join : plan.index("Window [sum(_s0", join)] if "Window [sum(_s0" in plan[join:] else plan[join:]
    assert rows_side.count("Window") >= 1 and rows_side[: rows_side.index("Scan")].count("Exchange") == 1


def test_range_frames_equal_plain_frames(hot):
    from pyspark.sql import Window as W

    from tapewatch.operators.sequence import range_frame

    tied = hot.withColumn("ts_us", F.floor(F.col("ts_us") / (600 * US)) * 600 * US)
    w = W.partitionBy("market_id").orderBy("ts_us").rangeBetween(-3 * HOUR, 0)
    want = tied.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.sum("size").over(w).alias("s"))
    got = range_frame(tied, "market_id", "ts_us", 3 * HOUR, {"n": ("count", F.lit(1)), "s": ("sum", F.col("size"))}).select("event_id", "n", "s")
    assert rows_of(got) == rows_of(want)


def test_time_bounds_reach_the_scan(spark):
    import re

    import __spark_entry__ as entry

    for name, column in (("a1_tier_coverage", "l_shipdate"), ("a3_coverage_total", "ts"), ("j14_consensus_ready", "ts")):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PushedFilters: \[[^\]]*GreaterThanOrEqual\({column}", plan), name


def test_component_ids_are_one_formula(spark):
    from tapewatch.operators.graph import member_ids

    rows = [("small", f"w{k}") for k in range(5)] + [("large", f"v{k}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "component string, node string")
    ids = {r.component: r.entity_id for r in member_ids(df, "e_").collect()}
    again = {r.component: r.entity_id for r in member_ids(df.orderBy(F.desc("node")).repartition(7), "e_").collect()}
    less = {r.component: r.entity_id for r in member_ids(df.filter("node not in ('w4', 'v19999')"), "e_").collect()}
    assert ids == again and all(less[k] != ids[k] and len(ids[k]) == 18 for k in ids)


def test_frames_hold_what_is_in_them(spark):
    """One huge, one infinite value, nulls, ties, a key of one third of all rows, frames of any length against plain frames."""
    import math
    import random

    from tapewatch.operators.sequence import range_frame

    draw = random.Random(3)
    rows = [(k, "hot" if k % 3 else f"k{k % 7}", draw.randint(-40, 400), draw.choice([10.0, 0.25, None])) for k in range(900)]
    rows += [(1000, "hot", 50, 1e13), (1001, "hot", 250, math.inf), (1002, None, 5, 1.0), (1003, None, 6, 2.0)]
    df = spark.createDataFrame(rows, "id long, key string, t long, x double")
    for before in (0, 1, 7, 60, 1000):
        got = {r.id: (r.n, r.s, r.low) for r in range_frame(df, "key", "t", before, {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "low": ("min", F.col("t"))}).collect()}
        for i, key, t, _ in rows:
            inside = [r for r in rows if r[1] == key and t - before <= r[2] <= t]
            known = [r[3] for r in inside if r[3] is not None]
            n, s, low = got[i]
            assert n == len(inside) and low == min(r[2] for r in inside) and (s is None) == (not known)
            assert s is None or s == sum(known) or abs(s - sum(known)) <= 1e-9 * sum(known)


def test_frames_keep_rows_of_a_task_bounded(spark, monkeypatch):
    """Counted rows set the tasks of a frame, whatever the shuffle's own number; results are those without a count."""
    from tapewatch.operators import sequence as Q

    monkeypatch.setattr(Q, "FRAME_ROWS", 100)
    df = spark.range(5_000).select(F.col("id"), (F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1009).alias("t"))
    frame = lambda rows: Q.range_frame(df, "k", "t", 50, {"n": ("count", F.lit(1)), "s": ("sum", F.col("id"))}, rows)
    many = frame(5_000)
    assert many.rdd.getNumPartitions() == 50 and sorted(map(tuple, many.collect())) == sorted(map(tuple, frame(None).collect()))


def test_shocks_of_one_coin_are_routed_by_many_tasks(spark):
    for n_shocks, n_markets in ((50, 400), (400, 50)):
        shocks = spark.range(n_shocks).select(F.col("id").alias("event_id"), F.lit("BTC1").alias("coin")).union(spark.createDataFrame([(7, "ETH9"), (8, None)], "event_id long, coin string"))
        markets = spark.range(n_markets).select(F.lit("BTC1").alias("coin"), F.concat(F.lit("m"), F.col("id")).alias("market_id"))
        out = joins.route_shocks(shocks, markets, pairs_a_task=1000)
        rows = out.select("event_id", "market_id", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.event_id, r.market_id) for r in rows) == sorted((e, f"m{m}") for e in range(n_shocks) for m in range(n_markets))
        assert len({r.task for r in rows}) >= 8
    assert joins.route_shocks(shocks.limit(0), markets).count() == 0
