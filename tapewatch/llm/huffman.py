"""Token-id files: canonical, length-limited Huffman codes in independent blocks with bit-offset checkpoints.

A file set is a folder with two Parquet tables:

* ``codebook``: one row per id that occurs, with its count and code length. Codes are canonical, so lengths are enough.
* ``blocks``: rows ``part, block, first_id, doc_ids, doc_lengths, checkpoints, bits``. Parts follow each other in ascending
  order of document id, blocks in a part likewise. A block holds whole documents, about ``block_ids`` ids in one bit
  stream, and the bit offset of every ``CHECKPOINT_IDS``-th id. Any block can be read alone, and all stretches
  between checkpoints are decoded side by side with one table lookup per id.

Null texts count as empty; every document ends with ``end_id``, so no document is without ids. A document longer than ``block_ids`` has a block of its own.
Null document ids come first. Rows of equal document id follow each other by the hash of their text. Empty tables give a file set without blocks.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage, map_batches

MAX_BITS = 16
CHECKPOINT_IDS = 256
BLOCK_IDS = 1 << 18
#: Longer runs of white space are cut out of a text before its pattern is matched, as tiktoken's matcher fails at a million.
LONG_RUN = 100_000
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
BLOCKS = "part int, block int, first_id bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, checkpoints binary, bits binary"


# --- ids ---------------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str):
    """Encoder for a byte-level BPE file whose ids are merge ranks; its special tokens in a text become their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # The byte-to-character map of byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    # The split pattern of byte-level BPE, fixed by the format.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    allowed, specials = set(special), tuple(special)

    def encode(text: str) -> list[int]:
        runs = [m.span() for m in WHITE.finditer(text) if m.end() - m.start() > LONG_RUN] if len(text) > LONG_RUN else []
        if not runs:
            return encoding.encode(text, allowed_special=allowed)
        ids, at = [], 0
        for begin, end in runs:
            # A run is one piece of the pattern, but for its last character if other text follows.
            if end < len(text) and not text.startswith(specials, end):
                end -= 1
            ids += encoding.encode(text[at:begin], allowed_special=allowed)
            ids += encoding._encode_single_piece(text[begin:end].encode())
            at = end
        return ids + encoding.encode(text[at:], allowed_special=allowed)

    return encode


def id_width(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
    return "<u2" if top < 1 << 16 else "<u4"


def token_ids(df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tie, ids``: the ids of each text and ``end_id`` as narrow unsigned integers."""
    width = id_width(tokenizer)
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make():
        encode = byte_encoder(tokenizer)

        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out, tie = [], []
            for t in batch.column("text").to_pylist():
                ids = encode(t)
                ids.append(end_id)
                out.append(np.array(ids, dtype=width).tobytes())
                tie.append(zlib.crc32(out[-1]))
            return [pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tie, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "tie", "ids"])]

        return step

    return map_batches(rows, make, "doc_id bigint, tie bigint, ids binary")


def global_counts(ids: DataFrame, width: str) -> DataFrame:
    """``id, n`` over all documents; each task adds up its own counts first."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                c = np.bincount(np.frombuffer(data.as_buffer(), dtype=width))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), dtype=np.int64)])
                total[: len(c)] += c
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


# --- codes -------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit into codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < n)  # at each place of the sorted list: is it a leaf?
        merged = weights[rank]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = is_leaf[:take]
        n_leaves = int(chosen.sum())
        lengths[:n_leaves] += 1
        take = 2 * (len(chosen) - n_leaves)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: ordered by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, limit: int = MAX_BITS):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.limit = limit
        spans = (np.int64(1) << (limit - lengths)).astype(np.int64)
        starts = np.cumsum(spans) - spans
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        self.code[ids], self.length[ids] = (starts >> (limit - lengths)).astype(np.uint64), lengths
        # One entry for each possible next `limit` bits.
        self.next_id, self.next_length = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.int64)
        self.next_id[: int(spans.sum())], self.next_length[: int(spans.sum())] = np.repeat(ids, spans), np.repeat(lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every CHECKPOINT_IDS-th id, and the bits."""
        length = self.length[ids]
        ends = np.cumsum(length)
        starts = ends - length
        total = int(ends[-1]) if len(ids) else 0
        word, left = starts >> 5, (starts & 31).astype(np.uint64)
        wide = self.code[ids] << (np.uint64(64) - left - length.astype(np.uint64))
        n = (total + 31) // 32 + 1
        # Codes share no bits, so sums over a word are exact in double precision (below 2**32).
        words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n + 1) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
        return starts[::CHECKPOINT_IDS].astype("<u8"), words.astype(">u4").tobytes()[: (total + 7) // 8]

    def decode(self, checkpoints: np.ndarray, bits: bytes, n: int) -> np.ndarray:
        """All ids of a block; the stretches between checkpoints advance together."""
        raw = np.concatenate([np.frombuffer(bits, dtype=np.uint8), np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at, out = checkpoints.astype(np.int64), np.zeros((CHECKPOINT_IDS, len(checkpoints)), dtype=np.uint32)
        last = len(windows) - 1
        for k in range(min(CHECKPOINT_IDS, n)):
            seen = (windows[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.limit)
            out[k] = self.next_id[seen]
            at += self.next_length[seen]
        return out.T.reshape(-1)[:n]


# --- files -------------------------------------------------------------------------------------------------------------


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write the file set to ``folder``.

    Ids are kept once as a compressed table, since code lengths need the counts of all documents. That table is what is sorted.
    """
    spark, width = df.sparkSession, id_width(tokenizer)
    ids = cut_lineage(token_ids(df, tokenizer, end_id, doc_id, text), compression="zstd")
    counts = global_counts(ids, width).orderBy("id").toArrow()  # at most one row per id of the vocabulary
    known, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    lengths = code_lengths(n)
    spark.createDataFrame(pa.table({"id": known, "n": n, "bits": lengths})).coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")

    def run(batches):
        book, part, block, first, docs, sizes, data, held = Codebook(known, lengths), 0, 0, 0, [], [], [], 0

        def out():
            every = np.frombuffer(b"".join(data), dtype=width)
            checkpoints, bits = book.encode(every)
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "first_id": [first], "n_ids": [len(every)], "doc_ids": [docs], "doc_lengths": [sizes], "checkpoints": [checkpoints.tobytes()], "bits": [bits]}, schema=BLOCK_TYPES)

        for batch in batches:
            for part, doc, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):  # noqa: B007
                x = x.as_buffer().to_pybytes()
                size = len(x) // np.dtype(width).itemsize
                if held and held + size > block_ids:
                    yield out()
                    block, first, docs, sizes, data, held = block + 1, first + held, [], [], [], 0
                docs.append(doc)
                sizes.append(size)
                data.append(x)
                held += size
        if docs:
            yield out()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/blocks")


BLOCK_TYPES = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("bits", pa.binary())])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, token_ids`` of a file set; ``start`` counts the ids of all documents before, ``token_ids`` are little-endian unsigned 32-bit."""
    book = spark.read.parquet(f"{folder}/codebook").orderBy("id").toArrow()  # at most one row per id of the vocabulary
    known, lengths = book["id"].to_numpy(), book["bits"].to_numpy()
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # One row per part, that is per writing task.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))
    bases = sizes.selectExpr("part", "sum(size) over (order by part rows between unbounded preceding and current row) - size as base")

    def make():
        code = Codebook(known, lengths)

        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            out = []
            for row in range(batch.num_rows):
                x = batch.slice(row, 1).to_pylist()[0]
                every = code.decode(np.frombuffer(x["checkpoints"], dtype="<u8"), x["bits"], x["n_ids"]).astype("<u4").tobytes()
                size = np.array(x["doc_lengths"], dtype=np.int64)
                begin = np.cumsum(size) - size
                ids = [every[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), size.tolist())]
                out.append(pa.RecordBatch.from_arrays([pa.array([x["part"]] * len(ids), pa.int32()), pa.array(x["doc_ids"], pa.int64()), pa.array(begin + x["first_id"]), pa.array(size), pa.array(ids, pa.binary())], names=["part", "doc_id", "offset", "n_tokens", "token_ids"]))
            return out

        return step

    # At most one row per writing task, so it may go to every executor; decoded ids then needn't be shuffled.
    bases = broadcast_if_small(bases)
    docs = map_batches(blocks, make, "part int, doc_id bigint, offset bigint, n_tokens bigint, token_ids binary")
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "token_ids")
