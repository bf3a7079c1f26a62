"""Ordered-sequence building blocks that stay balanced under hot keys.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here every key is cut
into slices of its ordering position (usually event time in microseconds), the window runs
per ``(key, slice)``, and only one summary row per slice travels across slice borders. The
number of summary rows per key is bounded by the covered time span over the slice width,
not by the number of input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

SLICE, KEY = "_slice", "_key"
US = 1_000_000
HOUR = 3600 * US
DAY = 24 * HOUR


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


#: Rows of one key that a slice should hold at most; more than these fit in memory beside each other in one task.
SLICE_ROWS = 500_000


def fit_width(df: DataFrame, keys, pos: str, width: int, rows: int = SLICE_ROWS) -> int:
    """A slice width of at most ``width`` for which no (key, slice) of ``df`` holds more than ``rows`` rows.

    Rows are counted per key and slice (one column-pruned pass with map-side sums); while the fullest slice holds too many, the width
    shrinks by the excess and only the slices that are too full are counted again. Rows of one position cannot be parted, so the
    width ends at 1. Call it on source rows, before operators that would be evaluated again.
    """
    keys, rest = _cols(keys), df.select(*_cols(keys), pos)
    while width > 1:
        cells = rest.groupBy(*keys, F.floor(F.col(pos) / F.lit(width)).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        fullest = cells.agg(F.max("_n")).head()[0] or 0
        if fullest <= rows:
            break
        width = max(1, int(width * rows / fullest / 2))
    return width


def with_slice(df: DataFrame, keys, pos: str, width: float) -> DataFrame:
    """Add the slice number ``floor(pos / width)`` and the keys as one struct.

    Struct keys compare null with null as equal, so that a plain equality join on (key, slice) reuses the rows' partitioning and
    sorting for null keys too.
    """
    return df.withColumn(KEY, F.struct(*_cols(keys))).withColumn(SLICE, F.floor(F.col(pos) / F.lit(width)).cast("long"))


def _attach(sliced: DataFrame, carry: DataFrame) -> DataFrame:
    """Join one carry row per (key, slice) onto the sliced rows, which stay where the window put them."""
    return sliced.join(carry.select(KEY, SLICE, "_carry"), [KEY, SLICE], "left")


def previous_row(
    df: DataFrame, keys, order, pos: str, width: float, values: dict[str, Column]
) -> DataFrame:
    """``lag`` over each key: adds ``values`` (name -> expression) taken from the preceding row."""
    order = _cols(order)
    sliced = with_slice(df, keys, pos, width)
    payload = F.struct(*[v.alias(n) for n, v in values.items()])
    tails = sliced.groupBy(KEY, SLICE).agg(
        F.max_by(payload, F.struct(*order)).alias("_tail")
    )
    carry = tails.select(
        KEY, SLICE, F.lag("_tail").over(W.partitionBy(KEY).orderBy(SLICE)).alias("_carry")
    )
    inside = W.partitionBy(KEY, SLICE).orderBy(*order)
    out = sliced.withColumn("_own", F.lag(payload).over(inside))
    out = _attach(out, carry).withColumn("_prev", F.coalesce("_own", "_carry"))
    return out.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in values])


_COMBINE = {
    "sum": lambda head, own: F.coalesce(head, F.lit(0)) + own,
    "count": lambda head, own: F.coalesce(head, F.lit(0)) + own,
    "max": lambda head, own: F.greatest(head, own),
    "min": lambda head, own: F.least(head, own),
    "last": lambda head, own: F.coalesce(own, head),
    "lag": lambda head, own: F.coalesce(own, head)["v"],
}


def running(
    df: DataFrame,
    keys,
    order,
    pos: str,
    width: float,
    aggs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Inclusive running aggregates per key; ``aggs`` maps name -> (kind, expression).

    Kinds: ``sum``, ``count`` (of non-null values), ``max``, ``min``, ``last`` (latest non-null
    value so far) and ``lag`` (value of the preceding row).
    """
    order = _cols(order)
    sliced = with_slice(df, keys, pos, width)
    for i, (_, (kind, expr)) in enumerate(aggs.items()):
        sliced = sliced.withColumn(f"_v{i}", F.struct(expr.alias("v")) if kind == "lag" else expr)
    per_slice, heads, own = [], [], []
    before = W.partitionBy(KEY).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(KEY, SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for i, (name, (kind, _)) in enumerate(aggs.items()):
        v, s = F.col(f"_v{i}"), F.col(f"_s{i}")
        if kind == "last":
            stamp = F.when(v.isNotNull(), F.struct(*order))
            per_slice.append(F.max_by(v, stamp).alias(f"_s{i}"))
            heads.append(F.last(s, ignorenulls=True).over(before).alias(name))
            own.append(F.last(v, ignorenulls=True).over(inside))
        elif kind == "lag":
            per_slice.append(F.max_by(v, F.struct(*order)).alias(f"_s{i}"))
            heads.append(F.last(s).over(before).alias(name))
            own.append(F.lag(v).over(W.partitionBy(KEY, SLICE).orderBy(*order)))
        else:
            fold = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
            merge = F.sum if kind in ("sum", "count") else fold
            per_slice.append(fold(v).alias(f"_s{i}"))
            heads.append(merge(s).over(before).alias(name))
            own.append(F.coalesce(F.sum(v).over(inside), F.lit(0)) if kind == "sum" else fold(v).over(inside))
    carry = sliced.groupBy(KEY, SLICE).agg(*per_slice)
    carry = carry.select(KEY, SLICE, F.struct(*heads).alias("_carry"))
    out = sliced
    for i, expr in enumerate(own):
        out = out.withColumn(f"_o{i}", expr)
    out = _attach(out, carry)
    return out.select(
        *[c for c in df.columns if c not in aggs],
        *[
            _COMBINE[kind](F.col(f"_carry.{name}"), F.col(f"_o{i}")).alias(name)
            for i, (name, (kind, _)) in enumerate(aggs.items())
        ],
    )


def islands(
    df: DataFrame,
    keys,
    order,
    pos: str,
    width: float,
    previous: dict[str, Column],
    starts: Column,
    name: str = "island",
) -> DataFrame:
    """Gaps and islands: number each island by the ordering struct of its first row.

    ``previous`` names the values taken from the preceding row; ``starts`` is a condition over
    the row and those values that opens a new island (the first row of a key always does).
    """
    order = _cols(order)
    sliced = with_slice(df, keys, pos, width)
    payload = F.struct(*[v.alias(n) for n, v in previous.items()])
    opens = F.coalesce(starts, F.lit(True))
    here = F.struct(*order)
    inside = W.partitionBy(KEY, SLICE).orderBy(*order)
    marked = (
        sliced.withColumn("_p", F.lag(payload).over(inside))
        .withColumn("_inner", F.col("_p").isNotNull())
        .select(*sliced.columns, "_inner", *[F.col(f"_p.{n}").alias(n) for n in previous])
        .withColumn("_mark", F.when(F.col("_inner") & opens, here))
        .select(*sliced.columns, "_mark")
    )
    # Per slice: its first row, the values its last row hands on, and its last inner start.
    summary = marked.groupBy(KEY, SLICE).agg(
        F.min_by(F.struct(*df.columns), here).alias("_first"),
        F.max_by(payload, here).alias("_tail"),
        F.max("_mark").alias("_last_mark"),
    )
    slices = W.partitionBy(KEY).orderBy(SLICE)
    bridged = (
        summary.withColumn("_p", F.lag("_tail").over(slices))
        .select(
            KEY, SLICE, "_last_mark",
            F.col("_p").isNull().alias("_opening"),
            *[F.col(f"_first.{c}").alias(c) for c in df.columns],
            *[F.col(f"_p.{n}").alias(n) for n in previous],
        )
        .withColumn("_head", F.when(F.col("_opening") | opens, here))
    )
    before = slices.rowsBetween(W.unboundedPreceding, -1)
    carried = F.last(F.coalesce("_last_mark", "_head"), ignorenulls=True).over(before)
    carry = bridged.select(KEY, SLICE, F.coalesce(F.col("_head"), carried).alias("_carry"))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    out = marked.withColumn("_own", F.last("_mark", ignorenulls=True).over(upto))
    out = _attach(out, carry)
    return out.select(*df.columns, F.coalesce("_own", "_carry").alias(name))


#: Rows that a task of a frame should hold, before each is copied once.
FRAME_ROWS = 250_000


def range_frame(df: DataFrame, keys, pos: str, before: int, aggs: dict[str, tuple[str, Column]], rows: int | None = None) -> DataFrame:
    """Aggregates over rows with ``pos`` in ``[current - before, current]`` of the same key; ``aggs`` maps name -> (kind, expression), kinds ``sum``, ``count`` (of non-null values), ``min`` and ``max``.

    Time is cut into tiles of the frame's length, so a frame is the rows of its own tile up to the current one and the last rows of the tile before. Both parts only grow along a tile (one read
    forwards, one backwards), so the cost does not depend on how many rows a frame holds, nothing is ever subtracted, and a huge or unlike number stays in the frames that hold it.
    Each row is copied once, with its values only, to the next tile; a key's tiles are dealt to tasks apart. Rows of equal ``pos`` count together. Sorts of both directions stand in one task: ``rows``,
    a count of the source's rows, sets as many tasks as keep that bounded.
    """
    keys, fold = _cols(keys), {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    tile = F.floor(F.col(pos) / F.lit(max(before, 1))).cast("long")
    values = [e.alias(f"_v{i}") for i, (_, e) in enumerate(aggs.values())]
    own = df.select("*", tile.alias(SLICE), F.col(pos).alias("_p"), F.lit(False).alias("_old"), *values)
    old = df.filter(F.col(pos).isNotNull()).select(*keys, (tile + 1).alias(SLICE), (F.col(pos) + F.lit(before)).cast(df.schema[pos].dataType).alias("_p"), F.lit(True).alias("_old"), *values)
    by_tile = W.partitionBy(*keys, SLICE)
    upto, since = (by_tile.orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.col("_p"), F.desc("_p")))
    both, parts = own.unionByName(old, allowMissingColumns=True), {}
    if rows and rows > FRAME_ROWS:
        both = both.repartition(-(-rows // FRAME_ROWS), *keys, SLICE)
    for i, (name, (kind, _)) in enumerate(aggs.items()):
        here, there = (fold[kind](F.when(F.col("_old") == F.lit(part), F.col(f"_v{i}"))).over(w) for part, w in ((False, upto), (True, since)))
        both = both.withColumn(f"_h{i}", here).withColumn(f"_t{i}", there)
        h, t = F.col(f"_h{i}"), F.col(f"_t{i}")
        parts[name] = F.least(h, t) if kind == "min" else F.greatest(h, t) if kind == "max" else F.coalesce(h + t, h, t)
    return both.filter(~F.col("_old")).select(*(c for c in df.columns if c not in parts), *(e.alias(n) for n, e in parts.items()))


def numbered(df: DataFrame, keys, order, pos: str, width: float, name: str = "rn") -> DataFrame:
    """Exact 1-based row number per key without sorting a key in one task."""
    return running(df, keys, order, pos, width, {name: ("count", F.lit(1))})


def row_frame(
    df: DataFrame,
    keys,
    order,
    pos: str,
    width: float,
    rows_before: int,
    aggs: dict[str, Column],
    include_current: bool = False,
    block: int | None = None,
    number: str | None = None,
) -> DataFrame:
    """Aggregates over the ``rows_before`` preceding rows of each key.

    Rows are numbered exactly, cut into blocks of consecutive numbers, and the last
    ``rows_before`` rows of each block are copied into the next one. ``number`` names an existing
    exact row number.
    """
    keys = _cols(keys)
    block = max(block or 64 * rows_before, rows_before)
    num = df.withColumn("_rn", F.col(number)) if number else numbered(df, keys, order, pos, width, "_rn")
    home = F.floor((F.col("_rn") - 1) / block).cast("long")
    last = F.floor((F.col("_rn") - 1 + rows_before) / block).cast("long")
    copies = num.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, last)))
    frame = W.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(
        -rows_before, 0 if include_current else -1
    )
    out = copies
    for name, agg in aggs.items():
        out = out.withColumn(name, agg.over(frame))
    return out.filter(F.col("_home") == F.col("_block")).drop("_home", "_block", "_rn")


def as_of(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_pos: str,
    right_pos: str,
    values: list[str],
    tie: str,
    width: float,
) -> DataFrame:
    """Backward as-of join: latest right row at or before each left row of the same key.

    Both sides are unioned and the right values carried forward; no pairs are formed. ``tie``
    orders left rows of equal position.
    """
    r = right.select(
        F.col(key),
        F.col(right_pos).alias("_pos"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("_tie"),
        F.struct(*values).alias("_right"),
        F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_left"),
    )
    l = left.select(
        F.col(key),
        F.col(left_pos).alias("_pos"),
        F.lit(1).alias("_kind"),
        F.col(tie).cast("long").alias("_tie"),
        F.lit(None).cast(r.schema["_right"].dataType).alias("_right"),
        F.struct(*left.columns).alias("_left"),
    )
    both = running(
        r.unionByName(l), key, ["_pos", "_kind", "_tie"], "_pos", width,
        {"_asof": ("last", F.col("_right"))},
    )
    return both.filter(F.col("_kind") == 1).select(
        "_left.*", *[F.col(f"_asof.{v}").alias(v) for v in values]
    )


def top_per_key(df: DataFrame, keys, order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key. Spark trims each map task to ``k`` rows per key before
    the shuffle (window group limit); for large ``k`` keys are first trimmed per hash salt."""
    keys = _cols(keys)
    w = W.partitionBy(*keys).orderBy(*order)
    out = df
    if k > 1000:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
        out = out.withColumn("_salt", salt)
        pre = W.partitionBy(*keys, "_salt").orderBy(*order)
        out = out.withColumn("_rn", F.row_number().over(pre)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    name = rank or "_rn"
    out = out.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def value_at_rank(
    df: DataFrame, keys, value: str, rank: Column, out: str = "value_at_rank", accuracy: int = 2000, one_key: bool = False
) -> DataFrame:
    """Exact order statistic per key: the ``rank``-th (0-based, expression over ``n``) smallest value.

    Values are pre-counted, a mergeable quantile sketch brackets the wanted rank, and only the
    counted values inside the bracket are ordered, so no task sorts a whole key. The bracket is
    widened by four times the sketch error on each side. ``one_key`` says that ``keys`` is a
    constant, so the one-row sketch is broadcast instead of shuffling all values to one task.
    """
    small = F.broadcast if one_key else (lambda d: d)
    keys = _cols(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    grid = [i / 200 for i in range(201)]
    sketch = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(value, grid, accuracy).alias("_grid"),
    )
    wanted = sketch.withColumn("_rank", rank.cast("long"))
    at = F.col("_rank") / F.col("n")
    slack = 4.0 / accuracy
    lo_i = F.floor(F.greatest(at - slack, F.lit(0.0)) * 200).cast("int")
    hi_i = F.ceil(F.least(at + slack + F.lit(1.0) / F.col("n"), F.lit(1.0)) * 200).cast("int")
    wanted = wanted.select(
        *keys, "n", "_rank",
        F.when(lo_i > 0, F.element_at("_grid", lo_i + 1)).alias("_lo"),
        F.when(hi_i < 200, F.element_at("_grid", hi_i + 1)).alias("_hi"),
    )
    below = F.col("_lo").isNotNull() & (F.col(value) < F.col("_lo"))
    joined = counted.join(small(wanted), keys)
    offset = joined.groupBy(*keys).agg(F.sum(F.when(below, F.col("_c")).otherwise(0)).alias("_below"))
    inside = joined.filter(~below & (F.col("_hi").isNull() | (F.col(value) <= F.col("_hi"))))
    w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = inside.join(small(offset), keys).withColumn("_upto", F.col("_below") + F.sum("_c").over(w))
    hit = ranked.filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    return sketch.select(*keys, "n").join(hit.select(*keys, F.col(value).alias(out)), keys, "left")


def near_pairs(
    left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, within: int, residual: Column
) -> DataFrame:
    """Interval join ``|left_pos - right_pos| <= within`` with a bucket as extra equi key.

    The left side is copied to the (at most three) buckets its interval touches; the pair keys
    ``on`` plus the bucket spread a hot key over its time span.
    """
    step = F.lit(max(within, 1))
    lo = F.floor((F.col(left_pos) - within) / step).cast("long")
    hi = F.floor((F.col(left_pos) + within) / step).cast("long")
    l = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    r = right.withColumn("_bucket", F.floor(F.col(right_pos) / step).cast("long"))
    return (
        l.join(r, [*on, "_bucket"])
        .filter((F.abs(F.col(left_pos) - F.col(right_pos)) <= within) & residual)
        .drop("_bucket")
    )
