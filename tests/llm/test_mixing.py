"""Pareto sampling against a plain ranking, and the targets against plain water-filling."""

import hashlib
import random
import re

import pytest

from tapewatch.llm import mixing

KIND = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Targets by repeated resharing of what is above twice a source's words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (1.5 * total - sum(2.0 * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if weight[s] * level > 2.0 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def plain_mix(rows, fills=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = {}
    for n, (_, _, s) in zip(size, rows):
        sizes[s] = sizes.get(s, 0) + n
    target, taken = plain_targets(sizes), [0] * len(rows)
    for s, most in target.items():
        rate = most / sizes[s] if sizes[s] else 0.0
        whole = int(rate)
        p, due = rate - whole, most - whole * sizes[s]
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        rank = {}
        for k in mine:
            taken[k] = whole * size[k]
            if p > 0:
                u = (int(hashlib.md5(f"mix:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                odds = u / (1 - u) * ((1 - p) / p)
                rank[k] = odds / (1 + odds)
        passed = -1.0
        for turn in range(1 + fills):
            words, now = 0, passed
            for r in sorted({rank[k] for k in rank if rank[k] > passed}):
                group = [k for k in rank if rank[k] == r and (not turn or size[k] <= due)]
                if group:
                    more = sum(size[k] for k in group)
                    if words + more > due:
                        break
                    words, now = words + more, r
                    for k in group:
                        taken[k] += size[k]
            due, passed = due - words, now
    return {(r[0], size[k], r[2], sizes[r[2]], round(target[r[2]], 6), taken[k]) for k, r in enumerate(rows)}


def rows_of(seed, n=600):
    draw = random.Random(seed)
    return [(k, " x " + " \t".join("w" * draw.randint(1, 3) for _ in range(draw.choice([0, 1, 5, 40, 300]))), draw.choice(["a", "a", "a", "b", "é", "Z", None, "few" if k < 9 else "a"])) for k in range(n)]


@pytest.mark.parametrize("cells, exact", [(4096, 10_000), (7, 5)])
def test_equals_plain_ranking(spark, cells, exact):
    rows = rows_of(3) + [(1000, "a b c", "dup")] * 40 + [(None, "one two", "a"), (2000, None, "none"), (2001, "", "none")]
    df = spark.createDataFrame(rows, KIND)
    got = {(r.doc_id, r.size, r.source, r.source_size, round(r.target, 6), r.taken) for r in mixing.plan_mix(df, cells=cells, exact=exact).rows(df).collect()}
    assert got == plain_mix(rows)


def test_words_come_near_targets_and_reruns_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plan = mixing.plan_mix(df)
    rows = plan.rows(df).collect()
    by = {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        n, _, largest = by.get(r.source, (0, 0, 0))
        by[r.source] = (n + r.taken, r.target, max(largest, r.size))
    assert all(0 <= most - n <= min(largest, 0.002 * most) for n, most, largest in by.values())
    again = mixing.plan_mix(df.repartition(5)).rows(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    assert plan.documents(df).count() == sum(r.copies for r in rows)


def test_importance_changes_the_odds(spark):
    rows = [(k, "a b c d e", "s") for k in range(4000)] + [(k, "a " * 100, "t") for k in range(4000, 4400)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "if(doc_id % 2 = 0, 1.5D, 0.5D) as worth")
    got = mixing.plan_mix(df, importance=mixing.F.col("worth")).rows(df).filter("source = 't'").collect()
    even, odd = ([r.copies for r in got if r.doc_id % 2 == k] for k in (0, 1))
    assert sum(even) > 1.2 * sum(odd) and abs(sum(r.taken for r in got) - got[0].target) <= 100


def test_empty_and_clashing_columns(spark):
    assert mixing.plan_mix(spark.createDataFrame([], KIND)).rows(spark.createDataFrame([], KIND)).count() == 0
    rows = [(k, "x " * (k % 9), f"s{k % 4}", "u", "v", 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, f"{KIND}, key string, size string, `p.q` double")
    plan = mixing.plan_mix(df)
    took = {r.doc_id: r.copies for r in plan.rows(df).collect()}
    out = plan.documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(k for k, n in took.items() for _ in range(n))
    zero = spark.createDataFrame([(1, None, "a"), (2, " ", None)], KIND)
    assert [(r.size, r.target, r.taken) for r in mixing.plan_mix(zero).rows(zero).collect()] == [(0, 0.0, 0)] * 2
