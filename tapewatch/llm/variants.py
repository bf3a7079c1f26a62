"""Spelling variants: pairs of words one edit apart, from blocked Gram matrices of letter counts.

Words become rows of letter counts. An edit changes the squared distance of two rows to one (a letter more or less) or two (a letter for another), so near words have a squared distance of at
most two and lie in blocks of equal or adjacent length. Distances come as ``|a|^2 + |b|^2 - 2 ab`` from the matrix product of two blocks; what is near enough is verified letter by letter.

Blocks are cells of words that agree in the sums of their counts over five sets of letters; an edit moves one sum by one or two sums in opposite directions, so only such
cells are multiplied (their lengths, the totals of the sums, are equal or adjacent). A cell of more than ``BLOCK`` words is several blocks. A block is compared with itself and
with one block of its neighbours after the other, so a task holds two. Only sums per word leave it: how many near words were found and the most frequent one. Other letters
than a-z share six columns, which can only lower a distance; the verification decides.

Work grows with the square of the vocabulary (not of the texts), as the method has it. Null texts have no words, a null id counts as empty in the deletion rule,
repeated rows count each, and tables without words give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage, map_batches, slices

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words in a block, and letters in a block of very long words.
BLOCK, BLOCK_LETTERS = 1024, 1 << 18
#: Different words that a task counts before it hands them on.
HELD = 100_000
COLUMNS = 32
#: Letters whose counts are added up to a cell's sums; the fifth set is all other letters.
GROUPS = ("ea", "no", "ti", "hr")
#: Counts of words up to this length have exact squared distances in single precision.
SINGLE = 2_000


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")  # bytes: only A-Z change


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = 31) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased, where a run whose crc32 with its document's id is a multiple of ``damage`` has lost a letter; those of enough letters and occurrences."""
    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def make():
        held: Counter = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        def step(batch: pa.RecordBatch):
            for part in slices(batch):
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    begin = zlib.crc32(f"{i}:".encode())
                    for run in runs.findall(_lower(t)):
                        h = zlib.crc32(run.encode(), begin)
                        if h % damage:
                            held[run] += 1
                        elif len(run) > least_length:
                            at = h % len(run)
                            held[run[:at] + run[at + 1 :]] += 1
                    if len(held) > HELD:
                        yield out()
            yield out()

        return step

    return map_batches(rows, make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts per column (a-z, then six that other letters share), code points padded with zeros, and lengths."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    points = np.zeros((len(words), max(1, length.max(initial=1))), dtype=np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(words)), length)
    points[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    column = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % 6).astype(np.int64)
    counts = np.bincount(row * COLUMNS + column, minlength=len(words) * COLUMNS).reshape(-1, COLUMNS).astype(np.float32 if length.max(initial=1) <= SINGLE else np.float64)
    return counts, points, length


def one_edit(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which rows of ``a`` (length n) and ``b`` (length m, n or n + 1) differ by exactly one edit."""
    same = a[:, :n] == b[:, :n]
    if n == m:
        return same.sum(axis=1) == n - 1
    ahead = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((a[:, :n] == b[:, 1 : n + 1])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= n


class Block:
    """Words of one length with their counts, as matrices whose product with another block's gives squared distances."""

    def __init__(self, packed: bytes):
        words, counts = zlib.decompress(packed).decode("utf-8").split("\0")
        self.words, self.weights = words.split("\n"), list(map(int, counts.split(" ")))
        letters, self.points, length = letter_counts(self.words)
        self.length, square, one = int(length[0]), (letters * letters).sum(axis=1)[:, None], np.ones((len(self.words), 1), letters.dtype)
        self.left, self.right = np.hstack([letters, square, one]), np.hstack([-2 * letters, one, square])

    @staticmethod
    def pack(words: list[str], counts: list[int]) -> bytes:
        return zlib.compress(("\n".join(words) + "\0" + " ".join(map(str, counts))).encode("utf-8"), 1)

    def near(self, other: Block) -> tuple[np.ndarray, np.ndarray]:
        """Places here and in ``other`` (of the same length or one more) of pairs one edit apart."""
        i, j = np.divmod(np.flatnonzero(self.left @ other.right.T <= 2), len(other.words))
        step, keep = max(1, (1 << 22) // other.length), []
        for k in range(0, len(i), step):
            keep.append(one_edit(self.points[i[k : k + step]], other.points[j[k : k + step]], self.length, other.length))
        keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        return i[keep], j[keep]


def _gather(best: dict, mine: np.ndarray, other: Block, theirs: np.ndarray) -> None:
    """Add to ``best`` (place -> number, best offer) the near words at ``theirs`` of the words at ``mine``."""
    for x, y in zip(mine.tolist(), theirs.tolist()):
        offer = (-other.weights[y], other.words[y])  # of equal counts the smaller word
        held = best.get(x)
        best[x] = (1, offer) if held is None else (held[0] + 1, min(held[1], offer))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best``: of every word of ``word, n`` that has near words their number and the most frequent (of equal ones the first in code-point order)."""
    length = F.length("word")
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    sums = {f"g{k}": length - F.length(F.translate(F.col("word"), letters, "")) for k, letters in enumerate(GROUPS)}
    cell = [*sums, f"g{len(GROUPS)}"]
    placed = words.select("word", "n", length.alias("length"), *(v.alias(c) for c, v in sums.items())).withColumn(cell[-1], F.col("length") - sum(map(F.col, sums)))
    parts = placed.groupBy(*cell, "length").agg(F.count(F.lit(1)).alias("held"))
    parts = cut_lineage(parts.select(*cell, F.ceil(F.col("held") / size).cast("int").alias("parts")))
    placed = placed.join(broadcast_if_small(parts), cell).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    lists = placed.groupBy(*cell, "part").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts")).withColumn("block", F.xxhash64(*cell, "part"))

    def packed():
        def step(batch: pa.RecordBatch):
            data = [Block.pack(w, n) for w, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(data, pa.binary())], names=[*batch.schema.names[:-2], "data"])

        return step

    kinds = ", ".join(f"{c} int" for c in [*cell, "part"])
    blocks = cut_lineage(map_batches(lists.select(*cell, "part", "block", "words", "counts"), packed, f"{kinds}, block bigint, data binary"))

    # Pairs of blocks by their names: a cell and those with one more in one sum, or one more in one and one less in a later sum.
    unit = lambda *at: [at.count(k) for k in range(len(cell))]
    steps = [unit(), *(unit(k) for k in range(len(cell))), *([x - y for x, y in zip(unit(k), unit(m))] for k in range(len(cell)) for m in range(k + 1, len(cell)))]
    names = blocks.select(*cell, "part", "block")
    moved = names.select("block", F.col("part").alias("own"), *cell, F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])).alias("s"))
    moved = moved.select(F.col("block").alias("one"), "own", *((F.col(c) + F.col("s")[k]).alias(c) for k, c in enumerate(cell)), F.forall("s", lambda x: x == 0).alias("same"))
    pairs = cut_lineage(moved.join(names, cell).filter(~F.col("same") | (F.col("own") < F.col("part"))).select("one", F.col("block").alias("two")))
    own = blocks.select(F.col("block").alias("one"), F.lit(0).alias("turn"), "data")
    others = pairs.join(blocks.select(F.col("block").alias("two"), "data"), "two").select("one", F.lit(1).alias("turn"), "data")

    def run(batches):
        key, held, best, out = None, None, {}, []

        def close():
            out.extend((held.words[x], n, -o[0], o[1]) for x, (n, o) in best.items())
            best.clear()

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])
            out.clear()
            return batch

        for batch in batches:
            for one, turn, data in zip(batch.column("one").to_pylist(), batch.column("turn").to_pylist(), batch.column("data")):
                other = Block(data.as_py())
                if one != key:
                    if key is not None:
                        close()
                    key, held = one, other  # a block's own row comes first
                    i, j = held.near(held)
                    _gather(best, i, held, j)
                    continue
                i, j = held.near(other)
                _gather(best, i, other, j)
                back: dict = {}
                _gather(back, j, held, i)
                out.extend((other.words[y], n, -o[0], o[1]) for y, (n, o) in back.items())
                if len(out) > 50_000:
                    yield made()
        if key is not None:
            close()
        yield made()

    tasks = 4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes
    some = own.union(others).repartition(tasks, "one").sortWithinPartitions("one", "turn").mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("low"), "best")).alias("b")).select("word", "n_near", (-F.col("b.low")).alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` of every word of ``word, n``: its form is the most frequent near word if at least ``ratio`` times as frequent, its root the last of its forms."""
    words = cut_lineage(words)
    near = near_words(words, block)
    formed = F.col("best_n") >= ratio * F.col("n")
    known = cut_lineage(words.join(near, "word", "left").select("word", "n", F.when(formed, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")))
    # Counts grow at least ``ratio`` times from form to form, so a few doublings reach the root.
    roots = known.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        roots = cut_lineage(roots)
        on = roots.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = roots.join(on, "root", "left")
        if nxt.filter("further is not null").isEmpty():
            return known.join(roots, "word").select("word", "n", "form", "root", "n_near", "form_n")
        roots = nxt.select("word", F.coalesce("further", "root").alias("root"))
