"""Small cases with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import decisions as D
from tapewatch.operators import graph as G
from tapewatch.operators import information as I
from tapewatch.operators import microstructure as M
from tapewatch.operators import performance as PF
from tapewatch.operators import reports as R
from tapewatch.operators import risk as RK
from tapewatch.operators import series as SR
from tapewatch.operators import wallets as A
from tapewatch.operators.sequence import US

MS = 1000
A1, B1, C1 = ("0x" + c * 40 for c in "abc")


def tape(spark, rows):
    """rows: (ts_ms, wallet, side, size, price, market)"""
    data = [(i, int(t * MS), w, m, m + "y", s, "YES", float(p), float(z), float(p * z), "MATCHED") for i, (t, w, s, z, p, m) in enumerate(rows)]
    return spark.createDataFrame(
        data, "event_id long, ts_us long, wallet string, market_id string, asset_id string, side string, outcome string, price double, size double, usd double, status string"
    )


def test_sweep_of_five_fills_is_one_parent(spark):
    rows = M.taker_sweeps(tape(spark, [(1000 + 2 * i, A1, "BUY", 10, 0.5, "m") for i in range(5)])).collect()
    assert len(rows) == 1 and rows[0].volume == 50.0 and rows[0].child_count == 5


def test_sweep_breaks_on_gap_side_and_taker(spark):
    t = tape(spark, [(0, A1, "BUY", 1, 0.5, "m"), (5, A1, "BUY", 1, 0.5, "m"), (16, A1, "BUY", 1, 0.5, "m"), (17, A1, "SELL", 1, 0.5, "m"), (18, B1, "SELL", 1, 0.5, "m")])
    assert sorted(r.child_count for r in M.taker_sweeps(t).collect()) == [1, 1, 1, 2]


def test_burst_needs_three_takers(spark):
    two = tape(spark, [(i * 10, (A1, B1)[i % 2], "BUY", 1, 0.5, "m") for i in range(6)])
    three = tape(spark, [(i * 10, (A1, B1, C1)[i % 3], "BUY", 1, 0.5, "m") for i in range(6)])
    assert M.cross_wallet_bursts(two).count() == 0
    got = M.burst_labels(M.cross_wallet_bursts(three)).collect()
    assert len(got) == 1 and got[0].members == 3 and got[0].label == "COORDINATED_SMURF"


def test_order_gap_of_exactly_the_limit_merges(spark):
    t = tape(spark, [(0, A1, "BUY", 10, 0.5, "m"), (30_000, A1, "BUY", 10, 0.7, "m"), (60_001, A1, "BUY", 1, 0.5, "m")])
    got = {r.fill_count: r for r in M.reconstruct_orders(t, 10**12).collect()}
    assert set(got) == {1, 2} and got[2].avg_price == pytest.approx((5 * 0.5 + 7 * 0.7) / 12) and got[2].order_type == "iceberg"


def test_entropy_of_balanced_flow_is_one_bit(spark):
    t = tape(spark, [(0, A1, "BUY", 4, 0.5, "m"), (1000, B1, "SELL", 4, 0.5, "m"), (9000, B1, "SELL", 4, 0.5, "m")])
    h = [r.entropy for r in M.rolling_entropy(t).orderBy("ts_us").collect()]
    assert h[0] is None and h[1] == pytest.approx(1.0) and h[2] is None


def test_cooldown_silences_and_reopens_across_slices(spark):
    times = [0, 1500, 2100, 3900, 4000, 4200, 9000]
    t = tape(spark, [(x, A1, "BUY", 2000, 0.5, "m") for x in times])
    for width in (3 * US, 5 * US, 3600 * US):
        got = sorted(r.ts_us // MS for r in M.cooldown_triggers(t, 500.0, 2 * US, slice_us=width).collect())
        assert got == [0, 2100, 4200, 9000], (width, got)


def test_position_replay_ignores_sale_without_position_and_reopens(spark):
    t = tape(spark, [(0, A1, "SELL", 5, 0.9, "m"), (1, A1, "BUY", 10, 0.2, "m"), (2, A1, "BUY", 10, 0.4, "m"), (3, A1, "SELL", 25, 0.5, "m"), (4, A1, "BUY", 4, 0.6, "m"), (5, A1, "SELL", 1, 0.9, "m")])
    row = A.replay_positions(t).collect()[0]
    assert row.quantity == pytest.approx(3.0) and row.avg_entry_price == pytest.approx(0.6)


def test_impact_p75_index_and_minimum(spark):
    big = [("a", 0.0001 * i) for i in range(1, 21)]
    small = [("b", 0.1)] * 9
    df = spark.createDataFrame(big + small, "asset_id string, lambda_obs double")
    got = {r.asset_id: r.own_p75 for r in R.impact_p75(df).collect()}
    assert got["a"] == pytest.approx(0.0016) and got["b"] is None


def test_linear_series_correlate_fully(spark):
    rows = [(m, i, float(f(i))) for m, f in (("a", lambda i: i), ("b", lambda i: 2 * i + 1), ("c", lambda i: -i)) for i in range(1, 9)]
    edges = I.correlation_edges(spark.createDataFrame(rows, "market string, lag_no int, value double"), "market", block_size=1)
    got = {(r.market_a, r.market_b): round(r.rho, 9) for r in edges.collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): -1.0, ("b", "c"): -1.0}


def test_short_series_give_no_edge(spark):
    rows = [(m, i, float(i)) for m in "ab" for i in range(1, 5)]
    assert I.correlation_edges(spark.createDataFrame(rows, "market string, lag_no int, value double"), "market").count() == 0


def test_deadline_ladder_and_monotone_check(spark):
    rows = [("m1", "peace-deal-by-april-30", 1, 0.46), ("m2", "peace-deal-by-may-31", 2, 0.28), ("m3", "peace-deal-by-june-30", 3, 0.27), ("m4", "solo-by-june-30", 3, 0.2)]
    members = SR.series_members(spark.createDataFrame(rows, "market_id string, slug string, end_us long, best_bid double"))
    series = SR.series_list(members).collect()
    assert [(s.series_id, s.members, s.series_type) for s in series] == [("peace-deal", 3, "DEADLINE_LADDER")]
    v = SR.ladder_violations(members).collect()
    assert len(v) == 1 and v[0].later_slug == "peace-deal-by-may-31" and v[0].gap == pytest.approx(0.18)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(100)]
    star = [("z_hub", f"z{i}") for i in range(50)]
    got = G.connected_components(spark.createDataFrame(chain + star, "a string, b string"), "a", "b")
    sizes = sorted((r.component, r["count"]) for r in got.groupBy("component").count().collect())
    assert sizes == [("n0000", 101), ("z0", 51)]


def test_drawdown_picks_first_deepest_point(spark):
    rows = [("s", 1, 1, 10.0, 10.0), ("s", 2, 2, -5.0, -5.0), ("s", 3, 3, 5.0, 5.0), ("s", 4, 4, -5.0, -5.0)]
    df = spark.createDataFrame(rows, "k string, trade_id long, closed_us long, pnl double, est double")
    r = PF.performance(df, "k").collect()[0]
    assert (r.max_drawdown, r.from_trade_id, r.to_trade_id) == (0.5, 1, 2) and r.win_rate == 0.5


def test_cluster_cap_and_hedge(spark):
    clusters = spark.createDataFrame([("a", "c", 1), ("b", "c", 1)], "market_id string, cluster_id string, internal_direction int")
    book = spark.createDataFrame([("a", 2000.0)], "market_id string, signed_usd double")
    none = spark.createDataFrame([], "cluster_id string, anchor string")
    edges = spark.createDataFrame([], "market_a string, market_b string, rho double")
    prop = spark.createDataFrame([(1, "b", 1000.0), (2, "b", -500.0), (3, "zz", 600.0), (4, "b", 100.0)], "proposal_id int, market_id string, proposed_usd double")
    got = {r.proposal_id: r.reason for r in RK.exposure_verdicts(prop, book, clusters, none, edges, 10_000.0).collect()}
    assert got == {1: "CLUSTER_EXPOSURE_CAP", 2: "HEDGE_REDUCES_ABS_NET_DELTA", 3: "UNKNOWN_CLUSTER_5PCT_CAP", 4: "OK"}


def test_expected_value_by_hand(spark):
    row = {
        "p_prior": 0.6, "quote_price": 0.5, "payout": 1.0, "capital_in": 1.0, "order_size": 10.0, "delta_t_ms": 0.0, "gamma": 0.001, "slippage_tolerance": 0.05, "min_ev": 0.0,
        "daily_opp_cost": 0.0, "days_to_resolution": 3.0, "imbalance": 0.0, "avg_entry_price": 0.1, "ping_ms": 10.0, "base_fee": 0.0, "kyle_lambda": 0.0, "gas_cost": 0.0, "kelly_cap": 0.25, "degraded": False,
    }
    r = D.gate(spark.createDataFrame([row])).collect()[0]
    assert r.ev_net == pytest.approx(0.6 * 10 - 1.0 - 1.0) and r.decision == "EXECUTE"


def test_wallet_transitions(spark):
    hits = spark.createDataFrame([(A1, "win")] * 4 + [(A1, "loss")] + [(B1, "loss")] * 5 + [(C1, "win")] * 2, "wallet string, outcome string")
    watched = spark.createDataFrame([(A1,), (B1,), (C1,)], "wallet string")
    got = {r.wallet: r.to_label for r in A.outcome_transitions(hits, hits.limit(0), watched).collect()}
    assert got == {A1: "SMART_MONEY_QUANT", B1: "NOISE", C1: "WATCHLIST_UNCERTAIN"}


def test_tier_rates_keep_all_rows(spark):
    df = spark.createDataFrame([(t * US,) for t in (0, 1, 59, 60)], "ts_us long")
    got = {r.window_us // US: r.events for r in R.rate_counts(df).collect()}
    assert got[0] == 3 and got[5] == 2 and got[60] == 1


def test_value_at_rank_matches_sorting(spark):
    import random

    rng = random.Random(5)
    rows = [(k, round(rng.lognormvariate(0, 2), 3)) for k in "ab" for _ in range(5000 if k == "a" else 37)]
    df = spark.createDataFrame(rows, "k string, v double")
    from tapewatch.operators.sequence import value_at_rank

    for q in (0.0, 0.5, 0.75, 0.999):
        got = {r.k: r.value_at_rank for r in value_at_rank(df, "k", "v", F.floor(F.col("n") * q)).collect()}
        for k in "ab":
            vals = sorted(v for kk, v in rows if kk == k)
            assert got[k] == vals[int(len(vals) * q)]


def test_sales_out_of_empty_positions(spark):
    sales = spark.createDataFrame([(1, "w", "m", "SELL_YES", 0.8, 5.0), (2, "w", "m", "SELL_YES", 0.8, 0.0), (3, "w", "n", "SELL_YES", 0.8, 2.0), (4, "w", "n", "SELL_YES", 0.8, 3.0)], "event_id long, wallet string, market_id string, trade_side string, price double, size double")
    held = spark.createDataFrame([("w", "m", 0.0, 0.5, "YES", "OPEN"), ("w", "n", 10.0, 0.5, "YES", "OPEN")], "wallet string, market_id string, total_size double, avg_entry_prob double, side string, position_status string")
    found = A.smart_exits(sales, held, spark.createDataFrame([("w", 0.9)], "wallet string, score double")).collect()
    assert sorted((r.event_id, str(r.sell_ratio)) for r in found) == [(1, "inf"), (2, "nan"), (4, "0.3")]


def test_effective_wallets_link_only_shared_islands(spark, monkeypatch):
    """Wallets that are alone in their islands need no node, and nodes are numbers."""
    from tapewatch.operators import graph

    seen, plain = [], graph.connected_components

    def components(edges, a, b):
        seen.append((edges.count(), sorted({kind for _, kind in edges.dtypes})))
        return plain(edges, a, b)

    monkeypatch.setattr(graph, "connected_components", components)
    rows = [("m1", "a", 0), ("m1", "b", 5), ("m1", "b", 100), ("m1", "c", 105), ("m1", "d", 300), ("m2", "a", 0), ("m2", "b", 50), ("m2", "c", 100), ("m3", None, 0)]
    trades = spark.createDataFrame([(m, w, t, k) for k, (m, w, t) in enumerate(rows)], "market_id string, wallet string, ts_us long, event_id long")
    got = {(r.market_id, r.effective_wallets, r.wallets) for r in graph.effective_wallets(trades, ["market_id"], 10, 60).collect()}
    assert got == {("m1", 2, 4), ("m2", 3, 3), ("m3", 1, 1)}
    assert seen == [(2, ["bigint"])]


def test_transfer_entropy_keeps_few_operators_in_a_task(spark):
    rows = spark.range(200).selectExpr("'k' AS key", "id AS idx", "cast(id % 7 AS double) AS x", "cast((id + 6) % 7 AS double) AS y")
    te = I.transfer_entropy(rows, ["key"])
    assert te._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    # Y takes the value that X had before; of a cycle Y's own past says as much.
    assert [(r.n, round(r.transfer_entropy, 9)) for r in te.collect()] == [(200, 0.0)]
    rows = spark.range(4000).selectExpr("'k' AS key", "id AS idx", "cast(pmod(xxhash64(id), 2) AS double) AS x", "cast(pmod(xxhash64(id - 1), 2) AS double) AS y")
    assert 0.98 < I.transfer_entropy(rows, ["key"]).head().transfer_entropy <= 1


def test_zscores_make_their_frames_once(spark):
    z = M.entropy_zscore(M.rolling_entropy(tape(spark, [(k, A1, "BUY" if k % 3 else "SELL", 1 + k % 5, 0.5, "m") for k in range(40)])))
    assert "LogicalRDD" not in z._jdf.queryExecution().optimizedPlan().toString()
    assert z.filter("z is not null").count() == 28


def test_stream_scores_of_many_levels_equal_single_ones():
    import numpy as np

    from tapewatch.streaming.processors import EntropyDetector

    levels = np.concatenate([np.round(np.random.default_rng(1).random(600), 3), np.full(250, 0.5), [0.1]])
    got = EntropyDetector(5)._scores(levels, 5, block=64)
    for k in range(5, len(levels)):
        prior = levels[max(0, k - 199) : k]
        sigma = prior.std(ddof=1) if prior.var(ddof=1) > 1e-12 else 1e-6
        want = np.clip((levels[k] - levels[k - 1]) / sigma, -50, 50) if k >= 11 else np.nan
        np.testing.assert_allclose(got[k - 5], want, rtol=1e-9, atol=1e-12)
