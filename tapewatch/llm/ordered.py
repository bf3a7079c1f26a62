"""Running counts and running XORs of a key's rows in order, when one key may hold a large part of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage


def running(df: DataFrame, key: str, order: list[Column], dealt: list[Column], xor: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """The columns ``key``, ``xor`` and ``keep`` with ``seq``, a row's place among the rows of its key (from 1), and ``<name>_run``, the XOR of the long column ``name`` up to and with the row.

    Rows are dealt by ranges of ``key`` (a long without nulls) and ``dealt``, the first of the sort columns ``order``, so that a key with many rows is spread over tasks; each task
    counts from its own start, and what stood before is added from one row per partition. Rows that tie in ``order`` are numbered in either order; an empty table gives no rows.
    """
    names = [key, *xor, *keep]
    added = ["_part", "seq", *(f"{x}_run" for x in xor)]

    def run(batches):
        from pyspark import TaskContext

        part, last, count, held = TaskContext.get().partitionId(), None, 0, np.zeros(len(xor), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, at = batch.column(0).to_numpy(), np.arange(n)
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            begin = np.maximum.accumulate(np.where(first, at, 0))
            goes_on = (begin == 0) & (keys[0] == last)
            seq = at - begin + 1 + np.where(goes_on, count, 0)
            sums = []
            for j in range(len(xor)):
                total = np.bitwise_xor.accumulate(batch.column(1 + j).to_numpy())
                before = np.where(begin > 0, total[begin - 1], 0)
                sums.append(total ^ before ^ np.where(goes_on, held[j], 0))
            last, count, held = keys[-1], int(seq[-1]), np.array([s[-1] for s in sums], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int64)), pa.array(seq), *map(pa.array, sums)], names=[*names, *added])

    kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{c}` bigint" for c in added])
    rows = cut_lineage(df.repartitionByRange(F.col(key), *dealt).sortWithinPartitions(F.col(key), *order).select(*names).mapInArrow(run, kinds))
    ends = cut_lineage(rows.groupBy("_part").agg(F.min(key).alias("_first"), F.max(F.struct(key, *added[1:])).alias("_last")))
    have = ends.select(F.col("_last")[key].alias(key), "_part", *(F.col("_last")[c].alias(c) for c in added[1:]), F.lit(0).alias("_asks"))
    asks = ends.select(F.col("_first").alias(key), "_part", *(F.lit(0).cast("bigint").alias(c) for c in added[1:]), F.lit(1).alias("_asks"))
    earlier = Window.partitionBy(key).orderBy("_part", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, -1)
    carried = have.union(asks).select(key, "_part", "_asks", F.sum("seq").over(earlier).alias("_c0"), *(F.expr(f"bit_xor(`{x}_run`)").over(earlier).alias(f"_c{j}") for j, x in enumerate(xor, 1)))
    carried = carried.filter("_asks = 1 and _c0 is not null").drop("_asks")  # one row per partition at most
    joined = rows.join(broadcast_if_small(carried), [key, "_part"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(*names, (F.col("seq") + zero("_c0")).alias("seq"), *(F.col(f"{x}_run").bitwiseXOR(zero(f"_c{j}")).alias(f"{x}_run") for j, x in enumerate(xor, 1)))
