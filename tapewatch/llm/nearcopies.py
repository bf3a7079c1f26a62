"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come first from covering SimHash (``simhash.links``) on fingerprints of these sets: every pair of fingerprints that differ in at most ``RADIUS`` bits meets, and
a spanning forest of these pairs is compared. A pair of similarity 0.8 differs in about ten bits, so what lies in different components goes on to min-hashing: ``BANDS`` keys of
``ROWS`` minima each. A pair of similarity 0.8 shares no key with probability (1 - 0.8**5)**40, about 1.3e-7, and a more similar pair less. All candidates are compared exactly, set against set, so no
pair below the similarity is linked.

Texts of equal sets are one node. In a bucket every node is first compared with the smallest. What that leaves in different components is compared pair by pair in buckets
of at most ``SMALL`` nodes. The nodes of larger ones go through a prefix index, which loses no link either: with shingles ordered from the rarest on, two sets of sizes n and m that share at least
a = 0.8 / 1.8 (n + m) of them first agree at places i and j with n - i >= a and m - j >= a. What is unlike by its rare parts (a common passage in other surroundings) never meets there.
An entry of the index compares with its smallest node first, then within parts of ``DRAWN`` nodes dealt by hash, and then what lies outside its main component with the rest: with a ``FEW``-th of it first, and
what that leaves outside with more, up to all. No bucket is cut short.

Words are lower-cased (A-Z only) and parted by ASCII white space; a text of fewer words than a shingle is one shingle. Texts without words (null ones
too) are copies of each other. Repeated rows are returned each. Empty tables give no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage, map_batches, slices
from tapewatch.llm.components import components
from tapewatch.llm.simhash import links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
#: Hashes whose minima are taken at once.
STRETCH = 1024
#: Nodes of a bucket that are compared pair by pair.
SMALL = 16
#: Rounds before an entry of the prefix index is compared with its main component, and the nodes of a part in these.
ROUNDS, DRAWN = 2, 6
#: One of so many nodes of an entry is compared with what lies outside its main component, round by round; in the last all are.
FEW = (32, 4, 1)
#: Nodes in more pairs than this are looked up by broadcast, if they are few.
HUB = 500
#: Documents per task and file of a step between shuffles, and the least such tasks. A step never has more tasks than its shuffle has partitions.
DOCS_A_PART, LEAST_PARTS = 5_000, 8

_draw = random.Random("near copies")
_constants = lambda n: np.array([_draw.getrandbits(64) | 1 for _ in range(n)], dtype=np.uint64)
FLIP, SPREAD, MIX, OF_BAND = _constants(BANDS * ROWS)[:, None], _constants(BANDS * ROWS)[:, None], _constants(ROWS), _constants(BANDS)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begin, end = np.concatenate([[0], ends[: len(words) - size]]).tolist(), (ends[size - 1 :] - 1).tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_of(joined[a:b]) for a, b in zip(begin, end)), dtype=np.uint64, count=len(begin)))


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes: a bit is set if more than half of them have it; zero for an empty one."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 64 * STRETCH):
        ones += np.unpackbits(hashes[k : k + 64 * STRETCH].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "little")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set; none of an empty one."""
    if not len(hashes):
        return hashes
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), STRETCH):
        np.minimum(low, ((hashes[k : k + STRETCH] ^ FLIP) * SPREAD).min(axis=1), out=low)
    return ((low >> np.uint64(7)) ^ low).reshape(BANDS, ROWS) @ MIX ^ OF_BAND


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *arrays]).view(np.int64)))


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, node, n, bits, keys``: a row's set by its hash, its size, its fingerprint and its band keys."""

    def make():
        import xxhash

        def step(batch: pa.RecordBatch):
            for part in slices(batch):
                sets = [shingle_set(t or "", shingle) for t in part.column("text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                bits = np.array([fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
                sketch = [part.column("doc_id"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits), _lists([band_keys(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(sketch, names=["doc_id", "node", "n", "bits", "keys"])

        return step

    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node bigint, n bigint, bits bigint, keys array<bigint>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` from ``text``."""

    def make():
        import xxhash

        def step(batch: pa.RecordBatch):
            for part in slices(batch, 100):
                sets = [shingle_set(t or "", shingle) for t in part.column("text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), _lists(sets)], names=["node", "hashes"])

        return step

    return map_batches(rows, make, "node bigint, hashes array<bigint>")


def _with_set(pairs: DataFrame, sets: DataFrame, node: str, hubs: DataFrame | None, parts: int) -> DataFrame:
    """Join the set of ``node``; nodes that many pairs share (``hubs``) don't meet in one task."""
    own = sets.select(F.col("node").alias(node), F.col("hashes").alias(f"{node}_set"))
    if hubs is None:
        return pairs.join(own, node).coalesce(parts)
    rare = pairs.join(hubs, pairs[node] == hubs["_hub"], "left_anti").join(own, node)
    hot = own.join(hubs, own[node] == hubs["_hub"], "left_semi").coalesce(parts)
    return rare.coalesce(parts).unionByName(pairs.join(hubs, pairs[node] == hubs["_hub"], "left_semi").join(broadcast_if_small(cut_lineage(hot)), node).coalesce(parts))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, parts: int) -> DataFrame:
    """The ``u, v`` whose sets are similar enough."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("_asked")).groupBy("_asked").agg(F.count(F.lit(1)).alias("_n"))
    asked = cut_lineage(asked.coalesce(parts))
    hubs = asked.filter(f"_n > {HUB}").select(F.col("_asked").alias("_hub"))
    hubs = None if hubs.isEmpty() else broadcast_if_small(hubs)
    sets = sets.join(broadcast_if_small(asked.select("_asked")), F.col("node") == F.col("_asked"), "left_semi")
    both = _with_set(_with_set(pairs.select("u", "v"), sets, "u", hubs, parts), sets, "v", hubs, parts)
    common = F.size(F.array_intersect("u_set", "v_set"))
    # Twelve places, so that a similarity that is exactly the bound counts.
    return both.filter(F.round(common / (F.size("u_set") + F.size("v_set") - common), 12) >= similarity).select("u", "v").coalesce(parts)


def _joined(roots: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """``node, root`` after further ``u, v`` links, which are contracted to links between the components found so far."""
    if links.isEmpty():
        return roots
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}r"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ur", "u").alias("u"), F.coalesce("vr", "v").alias("v"))
    merged = cut_lineage(components(between, parts).coalesce(parts))
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("low")), "root", "left").select("node", F.coalesce("low", "root").alias("root"))
    return cut_lineage(moved.union(merged.join(roots, "node", "left_anti")).coalesce(parts))


def _simhash_pairs(classes: DataFrame, parts: int) -> DataFrame:
    """``u, v``: nodes of one fingerprint with its smallest node, and the smallest nodes of fingerprints that ``links`` joins."""
    prints = cut_lineage(classes.groupBy("bits").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("held")).coalesce(parts))
    least = lambda c: prints.select(F.col("bits").alias(c), F.col("least").alias(f"{c}n"))
    between = cut_lineage(links(prints.select("bits")).coalesce(parts)).join(least("u"), "u").join(least("v"), "v").select(F.col("un").alias("a"), F.col("vn").alias("b"))
    same = classes.select("bits", "node").join(prints.filter("held > 1"), "bits").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return same.union(between).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(parts).distinct().coalesce(parts)


def _prefixes(nodes: DataFrame, sets: DataFrame, similarity: float, parts: int) -> DataFrame:
    """``shingle, node, n, at``: the places (from 0, the rarest first) of the shingles of ``node, n`` at which a similar set may first agree; shingles of one set only take places but are left out."""
    every = cut_lineage(nodes.join(sets, "node").select("node", "n", F.explode("hashes").alias("shingle")).coalesce(parts))
    shared = cut_lineage(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").coalesce(parts))
    held = cut_lineage(every.join(shared, "shingle").coalesce(parts))
    own = held.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    last = F.col("n") - F.ceil(F.col("n") * (similarity - 1e-9))
    by_rarity = Window.partitionBy("node").orderBy("f", "shingle")  # a window holds one set
    placed = held.join(own, "node").filter(F.col("n") - F.col("shared") <= last).withColumn("at", F.col("n") - F.col("shared") + F.row_number().over(by_rarity) - 1)
    return placed.filter(F.col("at") <= last).select("shingle", "node", "n", "at").coalesce(parts)


def _prefix_links(nodes: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, parts: int) -> DataFrame:
    """``roots``, the components ``node, root`` found so far, after all links among ``nodes``."""
    nodes = cut_lineage(nodes.coalesce(parts))
    if nodes.isEmpty():
        return roots
    entries, seen = cut_lineage(_prefixes(nodes, sets, similarity, parts)), None
    most = similarity / (1 + similarity)
    own = F.struct("node", "n", "at", "root")
    agree = lambda a, b: F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (most - 1e-9)
    for turn in range(ROUNDS + len(FEW)):
        rooted = cut_lineage(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).coalesce(parts))
        mixed = rooted.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min_by(own, F.col("node")).alias("p"), F.count(F.lit(1)).alias("held")).filter("a <> b")
        mixed = cut_lineage(mixed.select("shingle", "p", "held").coalesce(parts))
        if mixed.isEmpty():
            break
        if 0 < turn < ROUNDS:
            part = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("held") / DRAWN)).alias("part")
            dealt = cut_lineage(rooted.join(mixed.select("shingle", "held"), "shingle").select("shingle", part, own.alias("x")).coalesce(parts))
            pairs = dealt.join(dealt.withColumnRenamed("x", "y"), ["shingle", "part"]).filter((F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & agree("x", "y"))
            pairs = pairs.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))
        elif not turn:
            pairs = rooted.select("shingle", own.alias("x")).join(mixed.select("shingle", "p"), "shingle")
            pairs = pairs.filter((F.col("x.root") != F.col("p.root")) & agree("x", "p")).select(F.col("x.node").alias("x"), F.col("p.node").alias("y"))
        else:
            # The component with most nodes of an entry is its main one; each pair of components has a node outside of it.
            counts = rooted.join(mixed.select("shingle"), "shingle").groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c")).coalesce(parts)
            main = cut_lineage(counts.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m")).select("shingle", F.col("m.root").alias("main")).coalesce(parts))
            here = cut_lineage(rooted.join(main, "shingle").coalesce(parts))
            met = here.filter(F.pmod(F.xxhash64("node"), F.lit(FEW[turn - ROUNDS])) == 0)
            pairs = here.filter("root <> main").select("shingle", own.alias("x")).join(met.select("shingle", own.alias("y")), "shingle")
            pairs = pairs.filter((F.col("x.root") != F.col("y.root")) & agree("x", "y")).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))
        pairs = pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).coalesce(parts).distinct().coalesce(parts)
        pairs = cut_lineage(pairs if seen is None else pairs.join(seen, ["u", "v"], "left_anti").coalesce(parts))
        if not pairs.isEmpty():
            roots = _joined(roots, cut_lineage(_verified(pairs, sets, similarity, parts)), parts)
            seen = pairs if seen is None else seen.union(pairs)
    return roots


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, component_id``: the smallest id that a row reaches over links of at least ``similarity``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = cut_lineage(_sketches(rows, shingle))
    parts = max(LEAST_PARTS, docs.count() // DOCS_A_PART)
    firsts = [F.first(c).alias(c) for c in ("n", "bits", "keys")]
    classes = cut_lineage(docs.groupBy("node").agg(F.min("doc_id").alias("least"), *firsts).coalesce(parts))
    close = cut_lineage(_simhash_pairs(classes, parts))
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    # Most buckets hold one node; these leave after a count.
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    keyed = cut_lineage(keyed.join(cut_lineage(buckets.coalesce(parts)), "key").select("key", "node", "n").coalesce(parts))
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)

    nodes = keyed.select("node").union(close.select("u")).union(close.select("v")).distinct()
    named = nodes.join(classes.select("node", "least"), "node").select(F.col("least").alias("_asked")).coalesce(parts).distinct()
    asked = broadcast_if_small(cut_lineage(named.coalesce(parts)))
    # A null id matches itself, and rows of equal id may differ in text: a set is known by its hash.
    sets = cut_lineage(_sets(rows.join(asked, F.col("doc_id").eqNullSafe(F.col("_asked"))).select("text"), shingle).dropDuplicates(["node"]).coalesce(max(parts, 16)))

    roots = cut_lineage(components(cut_lineage(_verified(close, sets, similarity, parts)), parts).coalesce(parts))
    rooted = lambda: cut_lineage(keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).coalesce(parts))
    placed = rooted()
    lows = placed.groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("low"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key", "low")
    stars = placed.join(cut_lineage(lows.coalesce(parts)), "key").filter((F.col("root") != F.col("low.root")) & fits(F.col("n"), F.col("low.n")))
    stars = cut_lineage(stars.select(F.col("node").alias("u"), F.col("low.node").alias("v")).coalesce(parts).distinct().coalesce(parts))
    roots = _joined(roots, cut_lineage(_verified(stars, sets, similarity, parts)), parts)
    placed = rooted()
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("held")).filter("a <> b").select("key", "held")
    sized = cut_lineage(placed.join(mixed, "key").coalesce(parts))
    if not sized.isEmpty():
        small = sized.filter(F.col("held") <= SMALL)
        a, b = small.select("key", F.col("node").alias("u"), F.col("n").alias("un"), F.col("root").alias("ur")), small.select("key", F.col("node").alias("v"), F.col("n").alias("vn"), F.col("root").alias("vr"))
        rest = a.join(b, "key").filter((F.col("u") > F.col("v")) & (F.col("ur") != F.col("vr")) & fits(F.col("un"), F.col("vn"))).select("u", "v").coalesce(parts).distinct()
        rest = cut_lineage(rest.join(stars, ["u", "v"], "left_anti").coalesce(parts))
        roots = _joined(roots, cut_lineage(_verified(rest, sets, similarity, parts)), parts)
        roots = _prefix_links(sized.filter(F.col("held") > SMALL).select("node", "n").coalesce(parts).distinct(), sets, roots, similarity, parts)
    joined = cut_lineage(roots.join(classes.select("node", "least"), "node").coalesce(parts))
    lows = joined.groupBy("root").agg(F.min("least").alias("low"))
    named = joined.join(lows, "root").select("node", "low").coalesce(parts)
    known = cut_lineage(classes.select("node", "least").join(named, "node", "left").select("node", F.coalesce("low", "least").alias("component_id")).coalesce(parts))
    return docs.select("doc_id", "node").join(known, "node").select("doc_id", "node", "component_id")
