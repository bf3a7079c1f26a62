"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit places gets a non-zero vector of radius + 1 bits. Mask t, one for each non-zero vector t, keeps the places
whose vector has an odd product with t. Any ``radius`` places span a space that some t is orthogonal to, so two fingerprints that differ in at most
``radius`` places agree under that mask: every such pair meets in a table, without exception.

Tables hold distinct fingerprints only. A bucket of more than ``BUCKET`` of them is divided by a second family of masks with other
vectors, whose tables again bring every close pair of the bucket together, and so on until all are small; no bucket is cut short. In a bucket only
a spanning forest of its links is emitted, at most one edge per fingerprint, which keeps what is reachable.

Texts without words (null ones too) have fingerprint zero and are linked like any other. Repeated rows are
returned each. A null id never becomes a component's id unless the component has no other. Empty tables give no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage, map_batches, own_name
from tapewatch.llm.components import components

RADIUS = 3
BUCKET = 2048
#: Shingles whose bits are added up at once.
STRETCH = 1 << 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; a bit is set if more than half the hashes have it."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    size = min(shingle, len(words))
    begin, end = np.concatenate([[0], ends[: len(words) - size]]).tolist(), (ends[size - 1 :] - 1).tolist()
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(begin), STRETCH):
        hashes = np.array([hash_of(joined[a:b], seed) for a, b in zip(begin[k : k + STRETCH], end[k : k + STRETCH])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begin)).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, bits``: the fingerprint of each row as a signed long."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            bits = [fingerprint(t or "", shingle, seed) for t in batch.column("text").to_pylist()]
            return [pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(bits, dtype=np.uint64).view(np.int64))], names=["doc_id", "bits"])]

        return step

    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bits bigint")


def covering_masks(radius: int, level: int) -> list[int]:
    """The masks of one level, as signed longs; each level has vectors of its own."""
    draw = random.Random(f"covering {radius} {level}")
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    draw.shuffle(vectors)
    masks = [sum(1 << i for i, v in enumerate(vectors) if (v & t).bit_count() % 2) for t in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _tables(nodes: DataFrame, radius: int, level: int) -> DataFrame:
    """Each row of ``path, mask, bits`` once per table of this level."""
    masks = F.array(*[F.lit(m) for m in covering_masks(radius, level)])
    return nodes.select(F.col("path"), F.col("mask"), F.col("bits"), F.posexplode(masks).alias("t", "m")).select(
        (F.col("path") * (2 ** (radius + 1)) + F.col("t") + 1).alias("path"), F.col("mask").bitwiseOR(F.col("m")).alias("mask"), F.col("bits")
    ).withColumn("key", F.col("bits").bitwiseAND(F.col("mask")))


def spanning_edges(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links of at most ``radius`` differing bits join, at most one per fingerprint."""
    n = len(bits)
    if n == 2:
        near = int(bits[0] ^ bits[1]).bit_count() <= radius
        return bits[1:][:near], bits[:1][:near]
    label = np.arange(n)
    a, b = [], []
    for k in range(0, n, 256):
        i, j = np.nonzero(np.bitwise_count(bits[k : k + 256, None] ^ bits[None, :]) <= radius)
        i += k
        a.append(i[i > j])
        b.append(j[i > j])
    a, b = np.concatenate(a), np.concatenate(b)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    at = np.nonzero(label != np.arange(n))[0]
    return bits[at], bits[label[at]]


def _bucket_edges(rows: DataFrame, radius: int) -> DataFrame:
    """``u, v`` from rows that are dealt and sorted by (path, key); only an open bucket is held."""

    def run(batches):
        open_key, open_bits = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            path, key = batch.column("path").to_numpy(), batch.column("key").to_numpy()
            bits = batch.column("bits").to_numpy().view(np.uint64)
            cuts = np.nonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1]))[0] + 1
            u, v = [], []
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bits)]):
                here = (path[begin], key[begin])
                if here != open_key:
                    if len(open_bits) > 1:
                        x, y = spanning_edges(open_bits, radius)
                        u.append(x)
                        v.append(y)
                    open_key, open_bits = here, bits[begin:end]
                else:
                    open_bits = np.concatenate([open_bits, bits[begin:end]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], names=["u", "v"])
        if len(open_bits) > 1:
            u, v = spanning_edges(open_bits, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return rows.repartition("path", "key").sortWithinPartitions("path", "key").select("path", "key", "bits").mapInArrow(run, "u bigint, v bigint")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges between distinct fingerprints (column ``bits``) with the same reachability as all links within ``radius``."""
    nodes, level, found = distinct.select(F.lit(0).cast("bigint").alias("path"), F.lit(0).cast("bigint").alias("mask"), "bits"), 0, None
    while True:
        keyed = _tables(nodes, radius, level)
        # Most buckets hold one fingerprint; these leave after a count that is partly made on the map side.
        sizes = cut_lineage(keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        edges = _bucket_edges(keyed.join(sizes.filter(f"n <= {bucket}"), ["path", "key"]), radius)
        found = edges if found is None else found.union(edges)
        large = sizes.filter(f"n > {bucket}")
        if large.isEmpty():
            return found
        nodes, level = cut_lineage(keyed.join(large, ["path", "key"]).select("path", "mask", "bits")), level + 1


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, bits, component_id``: the smallest id that a row reaches over links of at most ``radius`` differing bits."""
    docs = cut_lineage(fingerprints(df, doc_id, text, shingle, seed))
    classes = docs.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = cut_lineage(components(links(docs.select("bits").distinct(), radius, bucket)))
    joined = roots.join(classes, roots["node"] == classes["bits"]).select("root", "node", "least")
    lows = joined.groupBy("root").agg(F.min("least").alias("low"))
    named = joined.join(lows, "root").select(F.col("node").alias("bits"), "low")
    # One row per distinct fingerprint, written so that the join below can split a fingerprint that many rows share.
    known = cut_lineage(classes.join(named, "bits", "left").select("bits", F.coalesce("low", "least").alias("component_id")))
    return docs.join(known, "bits").select("doc_id", "bits", "component_id")


def keep_representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", find=near_duplicates, **options) -> DataFrame:
    """One row of ``df`` per component that ``find`` names, with its columns: the row of the smallest id, of equal ids the one of the smallest text digest, of rows that
    repeat both the first; a row without id stays only if its component has no other.

    Rows are told apart by id and MD5 of the text, so no copy of the documents is made. Columns of any name stay as they are.
    """
    at, key, n = (own_name(df, c) for c in ("_order", "_key", "_n"))
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    order = F.struct(F.col(doc_id).isNull().alias("null"), F.col(doc_id).alias("id"), digest.alias("digest"))
    found = find(df.select(order.alias("_order"), F.col(text).alias("_text")), "_order", "_text", **options)
    kept = cut_lineage(found.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias(n)))
    joined = df.withColumn(at, order).join(broadcast_if_small(kept), F.col(at) == F.col(key))
    once = joined.filter(F.col(n) == 1)
    if not kept.filter(F.col(n) > 1).isEmpty():
        once = once.union(joined.filter(F.col(n) > 1).dropDuplicates([key]))
    return once.select(*(F.col(f"`{c}`") for c in df.columns))
