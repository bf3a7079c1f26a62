"""The prefix trie against a plain one."""

import hashlib
import random
import zlib

import pytest

from tapewatch.llm import trie

KIND = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """The contract's rows, from all prefixes of all rebuilt conversations."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, children = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == node)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt_turns(df), **options).drop("p1", "p2").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def deep_rows(seed):
    """Copies, a chain much longer than a shard, branches from it, nulls, ties, repeated rows, negative ids."""
    draw, rows = random.Random(seed), []
    chain = [(k, "user", f"deep {k}") for k in range(300)]
    rows += [(7, *t) for t in chain]
    for c in range(300, 340):  # leave the chain at some place
        at = draw.randint(0, 299)
        rows += [(c, *t) for t in chain[:at]] + [(c, at, "user", f"off {c % 3}")] + [(c, at + 1, "bot", "é" * (c % 4))] * (c % 3)
    for c in range(1000, 1150):  # copies
        rows += [(c, k, "user", f"same {k}") for k in range(7)]
    for c in range(2000, 2100):
        rows += [(c, draw.choice([None, 0, 1, 1, 2, 2, 3]), draw.choice([None, "", "user"]), draw.choice([None, "", "a", "b"])) for _ in range(draw.randint(1, 9))]
    rows += [(-5, 1, "user", "x"), (-105, 1, "user", "x"), (5000, 1, "user", "only"), (5000, 1, "user", "only"), (None, 1, "user", "nobody's"), (5001, None, None, None)]
    rows += [(c, 0, "user", "one") for c in range(6000, 6100)]  # of some nothing is left but the root
    return rows


@pytest.mark.parametrize("shard_rows, most", [(40, 7), (1000, 200_000)])
def test_equals_plain_trie(spark, shard_rows, most):
    rows = deep_rows(shard_rows)
    df = spark.createDataFrame(rows, KIND).repartition(6)
    want = plain_trie(rows)
    assert {r[1] for r in want} >= set(range(300)) and any(r[0] != 7 and r[1] > 250 for r in want)
    assert found(df, shard_rows=shard_rows, most=most) == want


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, k, "user", f"t{k}") for k in range(3000)] + [(c, 0, "user", "t0") for c in range(100, 150)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark.createDataFrame(rows, KIND), shard_rows=100) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_empty_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], KIND)) == []
    rows = [(1, 0, "user", "a"), (1, 1, None, "b" * 300_000), (101, 0, "user", "a")]
    more = "conv long, depth string, p1 string, seq int, chars int, t1 int, _part int, turns int, h int"
    df = spark.createDataFrame([(*r, 9, "x", "y", 1, 2, 3, 4, 5, 6) for r in rows], f"{KIND}, {more}")
    assert found(df) == plain_trie(rows)


def test_queue_spills_and_keeps_order():
    draw, queue = random.Random(4), trie.SpillingQueue(most=10)
    items = [(draw.randint(-5, 0), draw.randint(0, 3), draw.randint(0, 3), k, draw.getrandbits(60)) for k in range(500)]
    for x in items:
        queue.push(x)
    assert queue.spilled > 20
    got = [(key, sorted(queue.take(key))) for key in sorted({x[:3] for x in items})]
    assert got == [(key, sorted(x for x in items if x[:3] == key)) for key, _ in got] and not queue.heap and not queue.heads
