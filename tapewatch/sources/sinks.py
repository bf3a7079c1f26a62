"""Table writes: keyed upserts, guarded appends, retention and purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators.sequence import top_per_key

OVERWRITE, KEEP_OLD, MAXIMUM, COUNTER = "overwrite", "keep_old", "maximum", "counter"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str], version: str) -> DataFrame:
    """Merge ``new`` into ``old`` per key.

    Column policies: ``overwrite`` takes the latest new value, ``keep_old`` the latest non-null
    new value or else the old one, ``maximum`` the larger value and ``counter`` adds one per new
    row. ``version`` orders rows of one key. All policies are mergeable aggregates, so a key
    with very many updates is combined before the shuffle.
    """
    values = list(policies)
    both = old.select(*keys, version, *values, F.lit(0).alias("_new")).unionByName(
        new.select(*keys, version, *values, F.lit(1).alias("_new"))
    )
    age = F.struct("_new", version)
    folds: list[Column] = [F.max_by(version, age).alias(version)]
    for c, policy in policies.items():
        if policy == OVERWRITE:
            folds.append(F.max_by(F.struct(c), age).getField(c).alias(c))
        elif policy == KEEP_OLD:
            folds.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), age)).alias(c))
        elif policy == MAXIMUM:
            folds.append(F.max(c).alias(c))
        else:
            base = F.coalesce(F.sum(F.when(F.col("_new") == 0, F.col(c))), F.lit(0))
            folds.append((base + F.sum("_new")).cast("long").alias(c))
    return both.groupBy(*keys).agg(*folds)


def accepted_samples(samples: DataFrame) -> DataFrame:
    """Price-impact rows that may be stored."""
    return samples.filter((F.col("trade_size") > 0) & (F.col("lambda_obs") > 0))


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], rows: int) -> DataFrame:
    return top_per_key(df, keys, order, rows)


def unseen(new: DataFrame, stored: DataFrame, key: str, cursor_key: str) -> DataFrame:
    """Insert-or-ignore: rows past their cursor whose natural key is not stored, once per key."""
    cursors = stored.groupBy(cursor_key).agg(F.max("ts_us").alias("_cursor"))
    fresh = new.join(cursors, cursor_key, "left").filter(F.col("ts_us") > F.coalesce("_cursor", F.lit(0))).drop("_cursor")
    return fresh.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def purge(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split into kept rows, quarantined rows and one row of before/after counts."""
    flag = F.coalesce(bad, F.lit(False))
    counts = df.agg(F.count(F.lit(1)).alias("before"), F.count_if(~flag).alias("after"), F.count_if(flag).alias("purged"))
    return df.filter(~flag), df.filter(flag), counts


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold at most one distinct value (a sign of a broken feed)."""
    agg = df.agg(*[F.struct(F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c)["lo"] == F.col(c)["hi"], F.lit(True)).alias("is_constant")) for c in columns])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a full table version; readers pick the folder by number, so a lost job never leaves a half-written table in use."""
    path = f"{root}/v{version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v{version:012d}")


def newest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Number of the newest completely written version (below ``before``), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(path(status.getPath(), "_SUCCESS")):
            found.append(int(name[1:]))
    return max((v for v in found if before is None or v < before), default=None)
