"""Series correlation and transfer entropy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.lineage import cut_lineage
from tapewatch.operators.sequence import DAY, fit_width, numbered, top_per_key


#: Values of one series in a chunk; two blocks' chunks are held by a task.
CHUNK = 4096
#: Blocks that keys are dealt to, and the least and most keys of a block. Every value is copied once per block, and a unit of two blocks holds about ten numbers per pair.
BLOCKS, SMALL_BLOCK, LARGE_BLOCK = 32, 256, 2048


def latest_series(rows: DataFrame, key: str, order: list[str], value: str, length: int | None = None, slice_us: int = 31 * DAY) -> DataFrame:
    """The values of each key with their distance from the end (1 is the newest): all of them, or the last ``length``."""
    rows = rows.select(key, *order, value)
    if length:
        newest = top_per_key(rows, key, [F.desc(o) for o in order], length, "lag_no")
    else:
        newest = numbered_back(rows, [key], order, order[0], fit_width(rows, key, order[0], slice_us)).withColumnRenamed("back", "lag_no")
    return newest.select(key, "lag_no", F.col(value).alias("value"))


def correlation_edges(series: DataFrame, key: str, min_abs: float = 0.01, min_length: int = 5, block_size: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Pearson correlation of every pair of keys over their common latest values, as far back as the shorter series goes.

    All pairs are wanted, so the work is a blocked matrix product. Keys of similar length form blocks of about ``block_size`` (by default the keys are dealt to ``BLOCKS`` blocks, within bounds) and series are cut into chunks of ``chunk`` places, so a unit of
    work (two blocks, one chunk) has a bounded size however long a series is. A unit gives the co-moments (n, sums of x, y, xx, yy, xy) of its pairs by products with the values, their squares and their
    presence; values are taken from the key's mean, which leaves correlations as they are and sums small. A pair that ends in the first chunk is
    judged there and leaves only if it reaches ``min_abs``; co-moments of longer pairs are added up over their chunks.
    """
    # Lengths by powers of two: at most 63 classes, whose sizes are all that reaches the driver.
    sizes = cut_lineage(series.groupBy(F.col(key).alias("market")).agg(F.count(F.lit(1)).alias("length"), F.avg("value").alias("mean")).filter(F.col("length") >= min_length))
    band = F.floor(F.log2("length") + 1e-9).cast("int")
    held = {r.band: r.n for r in sizes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
    block_size = block_size or min(LARGE_BLOCK, max(SMALL_BLOCK, sum(held.values()) // BLOCKS))
    blocks, first = [math.ceil(held.get(k, 0) / block_size) for k in range(64)], [0]
    for n in blocks:
        first.append(first[-1] + n)
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    placed = sizes.withColumn("block", at(first, band) + F.pmod(F.xxhash64("market"), F.greatest(F.lit(1), at(blocks, band))).cast("int"))
    rows = series.select(F.col(key).alias("market"), "lag_no", "value").join(placed, "market").withColumn("chunk", F.floor((F.col("lag_no") - 1) / chunk).cast("int"))
    packed = rows.groupBy("block", "market", "length", "chunk").agg(F.array_sort(F.collect_list(F.struct("lag_no", (F.col("value") - F.col("mean")).alias("v")))).alias("_s"))
    packed = cut_lineage(packed.select("block", "market", "length", "chunk", F.transform("_s", lambda s: s["v"]).alias("values")))
    # A chunk meets only blocks whose series reach it; blocks are in order of length.
    reach = F.floor(F.log2(F.greatest(F.lit(1), F.col("chunk") * chunk + 1)) + 1e-9).cast("int")
    left = packed.select("market", "length", "values", "chunk", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(max(0, first[-1] - 1)))).alias("j"))
    right = packed.withColumn("low", F.least(at(first, reach), F.col("block"))).select(
        F.col("market").alias("market_r"), F.col("length").alias("length_r"), F.col("values").alias("values_r"), "chunk", F.explode(F.sequence("low", "block")).alias("i"), F.col("block").alias("j")
    )
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def moments(unit, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        chunk_no, i, j = unit
        out = pd.DataFrame({"market_a": pd.Series(dtype=object), "market_b": pd.Series(dtype=object), "whole": pd.Series(dtype=bool), **{c: pd.Series(dtype=float) for c in sums}})
        if a.empty or b.empty:
            return out
        width = max(max(map(len, a["values"])), max(map(len, b["values_r"])))

        def matrix(lists):
            x, m = np.zeros((len(lists), width)), np.zeros((len(lists), width))
            for k, v in enumerate(lists):
                x[k, : len(v)], m[k, : len(v)] = v, 1.0
            return x, m

        (x, mx), (y, my) = matrix(list(a["values"])), matrix(list(b["values_r"]))
        every = [mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T]
        la, lb = a["market"].to_numpy(dtype=object), b["market_r"].to_numpy(dtype=object)
        whole = (np.minimum(a["length"].to_numpy()[:, None], b["length_r"].to_numpy()[None, :]) <= chunk) & (chunk_no == 0)
        keep = every[0] > 0
        if i == j:
            keep &= la[:, None] < lb[None, :]
        keep &= ~whole | (np.abs(np.nan_to_num(rho_of(*every))) >= min_abs - 1e-9)
        p, q = np.nonzero(keep)
        swap = la[p] > lb[q]
        return pd.DataFrame({
            "market_a": np.where(swap, lb[q], la[p]), "market_b": np.where(swap, la[p], lb[q]), "whole": whole[p, q],
            **{c: np.where(swap, every[o][p, q], every[k][p, q]) for k, (c, o) in enumerate(zip(sums, (0, 2, 1, 4, 3, 5)))},
        })

    found = left.groupBy("chunk", "i", "j").cogroup(right.groupBy("chunk", "i", "j")).applyInPandas(moments, "market_a string, market_b string, whole boolean, " + ", ".join(f"{c} double" for c in sums))
    found = found.groupBy("market_a", "market_b").agg(*(F.sum(c).alias(c) for c in sums))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    flat = (vx <= F.col("sxx") * 1e-12) | (vy <= F.col("syy") * 1e-12) | (vx <= 1e-24) | (vy <= 1e-24)
    rho = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)
    return found.filter((F.col("n") >= min_length) & ~flat).select("market_a", "market_b", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("rho")).filter(F.abs("rho") >= min_abs)


def rho_of(n, sx, sy, sxx, syy, sxy):
    """Correlations from co-moments; not a number where a side is constant."""
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        return np.where((vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy), np.nan, (sxy - sx * sy / n) / np.sqrt(vx * vy))


def paired_correlations(series: DataFrame, key: str, pairs: DataFrame, min_length: int = 5) -> DataFrame:
    """Correlation of given key pairs over their common latest values, with built-in aggregates."""
    a = series.select(F.col(key).alias("market_a"), "lag_no", F.col("value").alias("va"))
    b = series.select(F.col(key).alias("market_b"), "lag_no", F.col("value").alias("vb"))
    j = pairs.join(a, "market_a").join(b, ["market_b", "lag_no"])
    return j.groupBy("market_a", "market_b").agg(F.count(F.lit(1)).alias("n"), F.corr("va", "vb").alias("rho")).filter(F.col("n") >= min_length)


def numbered_back(rows: DataFrame, keys: list[str], order: list[str], pos: str, width: int) -> DataFrame:
    """Add ``back``: 1 for the newest row of each key, 2 for the one before it, and so on, over all rows."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return numbered(rows, keys, order, pos, width, "_rn").join(counted, keys).withColumn("back", F.col("_n") - F.col("_rn") + 1).drop("_n", "_rn")


def transfer_entropy(pairs: DataFrame, key: list[str], threshold: float = 0.05, min_ticks: int = 50) -> DataFrame:
    """Lag-one transfer entropy X to Y in bits per key, from equal-width bins.

    ``pairs`` carries ``key, idx, x, y`` with consecutive ``idx``; keys of fewer than ``min_ticks`` pairs have no result. Each of
    the three series (Y now, Y before, X before) is binned over its own range.
    """
    pairs = cut_lineage(pairs.select(*key, "idx", "x", "y"))
    n = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_ticks)
    now = pairs.select(*key, (F.col("idx") - 1).alias("idx"), F.col("y").alias("yt"))
    # Written, as the ranges and the bins both read them: else a task would hold all joins and sums twice over.
    rows = cut_lineage(now.join(pairs.select(*key, "idx", F.col("y").alias("yl"), F.col("x").alias("xl")), [*key, "idx"]).select(*key, "yt", "yl", "xl"))
    ranges = rows.groupBy(*key).agg(*[f(v).alias(f"{v}_{s}") for v in ("yt", "yl", "xl") for f, s in ((F.min, "lo"), (F.max, "hi"))])
    j = rows.join(cut_lineage(ranges.join(n, key)), key)
    bins = F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.sqrt("n"))))

    def bin_of(v: str) -> Column:
        lo, hi = F.col(f"{v}_lo"), F.col(f"{v}_hi")
        step = F.floor((F.col(v) - lo) / (hi - lo) * bins + 1e-9)
        return F.when(hi > lo, F.least(step, bins - 1)).otherwise(0).cast("int").alias(f"{v}_b")

    b = j.select(*key, "n", bin_of("yt"), bin_of("yl"), bin_of("xl"))
    full = cut_lineage(b.groupBy(*key, "n", "yt_b", "yl_b", "xl_b").agg(F.count(F.lit(1)).alias("c")))
    # A key has a thousand cells at most. The entropy over some of the bins is log2(t) - sum(c * log2(cells equal in these bins)) / t, so all four come from one pass.
    cells = full.repartition(*key)
    for name, cols in (("s1", ["yl_b", "yt_b"]), ("s2", ["yl_b"]), ("s4", ["yl_b", "xl_b"])):
        cells = cells.withColumn(name, F.col("c") * F.log2(F.sum("c").over(Window.partitionBy(*key, *cols))))
    sums = cells.groupBy(*key, "n").agg(F.sum("c").alias("t"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum(F.col("c") * F.log2("c")).alias("s3"), F.sum("s4").alias("s4"))
    h = {k: F.log2("t") - F.col(f"s{k}") / F.col("t") for k in (1, 2, 3, 4)}
    te = F.greatest(F.lit(0.0), (h[1] - h[2]) - (h[3] - h[4]))
    return sums.select(*key, "n", te.alias("transfer_entropy")).withColumn("significant", F.col("transfer_entropy") > threshold)
