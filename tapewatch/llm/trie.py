"""Conversation prefix trie with subtree totals by time-forward processing.

A node is a distinct sequence of first turns; its key is its depth and the XOR of 128-bit hashes of (turn, place), so that the keys of all prefixes of a conversation are running XORs.

Totals move from the leaves to the root. Nodes are sorted by reverse level order (an external sort); a task takes them one after another, sends each node's totals to the
parent through a priority queue in the same order, and so finds a node's messages at the head of the queue when the node's turn comes. The queue spills sorted runs to the task's
own scratch files, which go with the task.

Shards are of bounded size whatever the texts: with ``below`` the turns that stand below a node over all members, a node is light if that is at most
``limit`` (``SHARD_ROWS``, or a ten-thousandth of all rows if more). A topmost light node with its subtree is a shard, dealt by hash. The heavy
nodes above form a small tree with at most ``rows / limit`` leaves. It is cut into paths that end in such a leaf and these into pieces of ``limit``
levels, again shards; the totals of the pieces (at most 20,001) then move across the shard roots in one more time-forward pass, and a last one spreads them within the pieces.

Null roles and texts count as empty. Rows without ``conv_id`` belong to no conversation. Rows of a conversation with equal ``turn`` are ordered by role, then text;
repeated rows are turns of their own. A table without conversations gives no nodes.
"""

from __future__ import annotations

import heapq
import struct
import tempfile
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage
from tapewatch.llm.ordered import running

SHARD_ROWS, SHARDS = 1_000, 10_000
#: Messages that a queue holds before it writes a sorted run.
QUEUE = 200_000
#: Ids of one end list that are joined before they are dealt to its node.
IDS = 256

NODE, PARENT = ["depth", "p1", "p2"], ["up", "q1", "q2"]


def rebuilt_turns(df: DataFrame, group: int = 100, heads: int = 6, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, depth, turns, chars, t1, t2``: every conversation c with its first h turns taken from conversation c - c % ``group`` (as many as that has), h = crc32(c) % ``heads``.

    One row per turn, and one of depth 0 per conversation, with its number of turns; t1 and t2 are hashes of the turn.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = df.select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).filter("conv is not null")
    own = own.select("*", F.length("text").cast("bigint").alias("chars"), *(F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)))
    first = F.col("turn").asc_nulls_first()
    own = cut_lineage(running(own, "conv", [first, F.col("role"), F.col("text")], [first], keep=["chars", "t1", "t2"]))
    base = F.col("conv") - F.col("conv") % group
    convs = own.groupBy("conv").agg(F.max("seq").alias("own")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads)
    lead = own.filter((F.col("conv") == base) & (F.col("seq") < heads)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("seq", "chars", "t1", "t2"))).alias("lead"))  # fewer than ``heads`` each
    convs = convs.withColumn("base", base).join(lead, "base", "left").withColumn("lead", F.expr("filter(coalesce(lead, array()), x -> x.seq <= h)")).withColumn("taken", F.size("lead").cast("bigint"))
    convs = cut_lineage(convs.select("conv", "h", "lead", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")))
    body = own.join(convs.drop("lead"), "conv").filter("seq > h").select("conv", (F.col("seq") - F.col("h") + F.col("taken")).alias("depth"), "turns", "chars", "t1", "t2")
    top = convs.select("conv", "turns", F.explode("lead").alias("x")).select("conv", F.col("x.seq").alias("depth"), "turns", "x.chars", "x.t1", "x.t2")
    zero = F.lit(0).cast("bigint")
    return convs.select("conv", zero.alias("depth"), "turns", zero.alias("chars"), zero.alias("t1"), zero.alias("t2")).union(top).union(body)


class SpillingQueue:
    """A priority queue of tuples of five long integers, the least first; beyond ``most`` tuples it writes sorted runs to unnamed scratch files."""

    ROW = struct.Struct("<5q")

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.heads, self.spilled = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            run = tempfile.TemporaryFile()
            rows = iter(self.heap)
            while block := b"".join(self.ROW.pack(*x) for x in islice(rows, 10_000)):
                run.write(block)
            run.seek(0)
            self.spilled, self.heap = self.spilled + 1, []
            self._advance(self._read(run), self.spilled)

    def _read(self, run):
        with run:
            while block := run.read(self.ROW.size * 1_000):
                yield from self.ROW.iter_unpack(block)

    def _advance(self, rows, number: int) -> None:
        if (item := next(rows, None)) is not None:
            heapq.heappush(self.heads, (item, number, rows))

    def take(self, key: tuple) -> list[tuple]:
        """Remove and return the messages whose first three numbers are ``key``."""
        out = []
        while self.heap and self.heap[0][:3] == key:
            out.append(heapq.heappop(self.heap))
        while self.heads and self.heads[0][0][:3] == key:
            item, number, rows = heapq.heappop(self.heads)
            out.append(item)
            self._advance(rows, number)
        return out


def time_forward(nodes: DataFrame, shard: list[str], keep: list[str] = (), most: int = QUEUE) -> DataFrame:
    """``nodes`` with ``got`` (messages received) and the totals ``leaves`` and ``saved`` of each node's subtree in its shard.

    ``nodes`` has the keys of node and parent, ``top`` (the parent is in no or another shard), ``lone`` (a node without messages is a leaf), and its own ``leaves`` and ``saved``.
    Shards are dealt by the columns ``shard``.
    """
    names = [*NODE, *PARENT, "top", "lone", "leaves", "saved", *keep]

    def run(batches):
        queue = SpillingQueue(most)
        for batch in batches:
            got, leaves, saved = [], [], []
            for depth, p1, p2, up, q1, q2, top, lone, own_leaves, own_saved in zip(*(c.to_pylist() for c in batch.columns[:10])):
                messages = queue.take((-depth, p1, p2))
                for m in messages:
                    own_leaves += m[3]
                    own_saved += m[4]
                if lone and not messages:
                    own_leaves += 1
                if not top:
                    queue.push((-up, q1, q2, own_leaves, own_saved))
                got.append(len(messages))
                leaves.append(own_leaves)
                saved.append(own_saved)
            made = {"got": pa.array(got, pa.int64()), "leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(c) if c in made else batch.column(c) for c in [*names, "got"]], names=[*names, "got"])

    kinds = ", ".join([f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in names] + ["got bigint"])
    dealt = nodes.repartition(*shard) if shard else nodes.repartition(1)
    return dealt.sortWithinPartitions(F.desc("depth"), "p1", "p2").select(*names).mapInArrow(run, kinds)


def _spread(heavy: DataFrame, limit: int, most: int) -> DataFrame:
    """The totals of the heavy nodes, whose ``leaves``, ``saved`` and ``children`` hold what light children sent."""
    own = heavy.withColumn("piece", F.floor(F.col("depth") / limit))
    up = own.select(*(F.col(a).alias(b) for a, b in zip(NODE, PARENT)), F.col("path").alias("up_path"), F.col("piece").alias("up_piece"))
    inner = own.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("inner")).select(*(F.col(b).alias(a) for a, b in zip(NODE, PARENT)), "inner")
    own = own.join(up, PARENT, "left").join(inner, NODE, "left").withColumn("children", F.col("children") + F.coalesce("inner", F.lit(0)))
    own = own.withColumn("top", F.coalesce((F.col("up_path") != F.col("path")) | (F.col("up_piece") != F.col("piece")), F.lit(True))).withColumn("lone", F.col("children") == 0)
    keep = ["path", "piece", "up_path", "up_piece", "conv_id", "n_convs", "children"]
    own = cut_lineage(own.select(*NODE, *PARENT, "top", "lone", "leaves", "saved", *keep))

    tops = cut_lineage(time_forward(own, ["path", "piece"], keep, most).filter("top"))
    at = tops.select(F.col("path").alias("up_path"), F.col("piece").alias("up_piece"), F.col("depth").alias("top_up"), F.col("p1").alias("top_q1"), F.col("p2").alias("top_q2"))
    roots = tops.join(at, ["up_path", "up_piece"], "left").select(*NODE, *(F.coalesce(f"top_{c}", F.lit(-1)).cast("bigint").alias(c) for c in PARENT), F.col("top_up").isNull().alias("top"), F.lit(False).alias("lone"), "leaves", "saved", F.struct(*PARENT).alias("parent"))
    across = time_forward(roots, [], ["parent"], most).filter(~F.col("top"))
    sent = cut_lineage(across.groupBy(*(F.col(f"parent.{c}").alias(c) for c in PARENT)).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    sent = sent.select(*(F.col(b).alias(a) for a, b in zip(NODE, PARENT)), "more_leaves", "more_saved")
    own = own.join(sent, NODE, "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
    return time_forward(own, ["path", "piece"], keep, most)


def end_hashes(ends: DataFrame, ids: int = IDS) -> DataFrame:
    """SHA-256 (hex) of the ascending, comma-joined ids ``conv`` of every node of ``ends``: lists are joined in parts first, and a node's parts go through one running hash."""
    ends = cut_lineage(ends)
    counted = cut_lineage(ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")))
    one = counted.filter("n = 1").select(*NODE, F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = ends.join(counted.filter("n > 1").select(*NODE), NODE).select(*NODE, "conv")

    def join_ids(batches):
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[3]):
                continue
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            at = np.nonzero((np.arange(len(new)) - begin) % ids == 0)[0]
            said = list(map(str, cols[3].tolist()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), pa.array([",".join(said[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(said)])])], names=[*NODE, "conv", "ids"])

    def digest(batches):
        import hashlib

        key = held = None
        out = []
        for batch in batches:
            for *node, part in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"])):
                if node != key:
                    if key is not None:
                        out.append((*key, held.hexdigest()))
                    key, held = node, hashlib.sha256(part.encode())
                else:
                    held.update(b"," + part.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*NODE, "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, held.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*NODE, "ends_sha256"])

    parts = many.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(join_ids, "depth bigint, p1 bigint, p2 bigint, conv bigint, ids string")
    rest = parts.repartition(*NODE).sortWithinPartitions(*NODE, "conv").drop("conv").mapInArrow(digest, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")
    return one.union(rest)


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS, most: int = QUEUE) -> DataFrame:
    """One row per node of the trie of ``turns`` (as ``rebuilt_turns`` returns them): its key (``depth, p1, p2``), ``parent_conv_id``, ``conv_id`` (smallest member), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    zero = F.lit(0).cast("bigint")
    keyed = turns.select("conv", "depth", "turns", "chars", *(F.when(F.col("depth") == 0, zero).otherwise(F.xxhash64(F.lit(k), "t1", "t2", "depth")).alias(f"x{k}") for k in (1, 2)))
    rows = running(keyed, "conv", [F.col("depth")], [F.col("depth")], xor=["x1", "x2"], keep=["depth", "turns", "chars"])
    rows = cut_lineage(rows.select("conv", "depth", F.col("x1_run").alias("p1"), F.col("x2_run").alias("p2"), (F.col("depth") - 1).alias("up"), *(F.col(f"x{k}_run").bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)), "turns", "chars"))
    limit = max(shard_rows, rows.count() // SHARDS)

    heavy = cut_lineage(rows.groupBy(*NODE, *PARENT).agg(F.sum(F.col("turns") - F.col("depth") + 1).alias("below")).filter(F.col("below") > limit).select(*NODE, *PARENT))
    inner = heavy.select(*(F.col(b).alias(a) for a, b in zip(NODE, PARENT))).distinct().withColumn("inner", F.lit(True))
    marked = broadcast_if_small(cut_lineage(heavy.select(*NODE).join(inner, NODE, "left").select(*NODE, F.col("inner").isNull().alias("leaf"))))
    found = rows.select("conv", *NODE).join(marked, NODE, "left")
    is_heavy = F.col("leaf").isNotNull()
    of_conv = found.groupBy("conv").agg(F.max(F.when(is_heavy, F.struct("depth", "leaf", "p1"))).alias("deep"), F.min(F.when(~is_heavy, F.struct("depth", "p1"))).alias("light"))
    of_conv = of_conv.select("conv", F.coalesce(F.col("deep.depth"), F.lit(-1)).alias("deep"), F.when(F.col("deep.leaf"), F.col("deep.p1")).alias("path"), F.col("light.depth").alias("top_depth"), F.col("light.p1").alias("shard"))
    whole = rows.drop("turns").join(of_conv, "conv").groupBy(*NODE, *PARENT).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.max("deep").alias("deep"), F.min("path").alias("path"), F.min("top_depth").alias("top_depth"), F.min("shard").alias("shard")
    )
    nodes = cut_lineage(whole.select(*NODE, *PARENT, "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), "path", "shard", (F.col("depth") <= F.col("deep")).alias("heavy"), (F.col("depth") == F.col("top_depth")).alias("top")))

    light = nodes.filter("not heavy").select(*NODE, *PARENT, "top", F.lit(True).alias("lone"), zero.alias("leaves"), "saved", "shard", "conv_id", "n_convs")
    light = cut_lineage(time_forward(light, ["shard"], ["conv_id", "n_convs"], most).withColumnRenamed("got", "children"))
    done = light.select(*NODE, *PARENT, "conv_id", "n_convs", "children", "leaves", "saved")
    if not heavy.isEmpty():
        sent = light.filter("top").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("sent")).select(*(F.col(b).alias(a) for a, b in zip(NODE, PARENT)), "children", "leaves", "sent")
        above = nodes.filter("heavy").drop("top").join(sent, NODE, "left").na.fill(0, ["children", "leaves", "sent"]).withColumn("saved", F.col("saved") + F.col("sent"))
        done = done.union(_spread(cut_lineage(above), limit, most).select(*done.columns))
    parents = nodes.select(*(F.col(a).alias(b) for a, b in zip(NODE, PARENT)), F.col("conv_id").alias("parent_conv_id"))
    ends = end_hashes(rows.filter("depth = turns").select(*NODE, "conv"))
    out = done.join(parents, PARENT, "left").join(ends, NODE, "left")
    return out.select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
