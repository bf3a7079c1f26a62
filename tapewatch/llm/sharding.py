"""Sharding with a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own: an offset and a step from its name's hash, stepping round the table.
Shards take turns, each claiming its most preferred free slot, until none is free. All shards then own the same number of slots within one, and a
change of the shard list moves few slots. Each place of a key is one hash and one lookup in the table, which is broadcast; the table's size is its bound.

Null keys are placed like the empty string, keys of any type by their text. Repeated keys get equal shards. Shard names must be distinct and at least one.
Empty tables give no rows. Columns of the input that have the name of an output column are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import own_name

#: Slots per shard, about; more slots even out the shares and keep more places when shards change.
SLOTS_PER_SHARD = 100


def prime_from(n: int) -> int:
    """The smallest prime of at least ``n``."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def text_hash(text: str) -> int:
    """The first 15 hexadecimal digits of MD5, the same in Spark and here."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard; the size being prime, any step visits every slot."""
    return text_hash(f"offset:{shard}") % size, text_hash(f"step:{shard}") % (size - 1) + 1 if size > 2 else 1


def fill(shards: list[str], size: int) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct and at least one")
    owner, place = [-1] * size, [preference(s, size) for s in shards]
    at, free = [offset for offset, _ in place], size
    while free:
        for k, (_, step) in enumerate(place):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """``slot, shard`` for every slot of the smallest prime size of at least ``slots_per_shard`` slots per shard."""
    owner = fill(shards, prime_from(slots_per_shard * len(shards)))
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, owner))), ",")
    listed = spark.range(1).select(F.posexplode(owners).alias("slot", "k"))
    return listed.select(F.col("slot").cast("bigint").alias("slot"), F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(size))


def place(df: DataFrame, shards: list[str], key: str = "doc_id", slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row of ``df``, in place of columns of these names; all others stay."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("slot", "shard") and c != key])
    size = prime_from(slots_per_shard * len(shards))
    slots = F.broadcast(lookup_table(df.sparkSession, shards, slots_per_shard))  # `size` rows
    own = own_name(df, "_slot")
    placed = df.withColumn(own, slot_of(F.col(key), size))
    return placed.join(slots, placed[own] == slots["slot"], "left").drop(own)


def write_shards(df: DataFrame, folder: str, shards: list[str], key: str = "doc_id", salts: int = 8) -> None:
    """Write ``df`` with one subfolder per shard; each shard is written by up to ``salts`` tasks, whatever its share of rows."""
    placed = place(df, shards, key)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(folder)
