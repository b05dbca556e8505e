"""Operator 3: shards from a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a skip.  Shards take turns:
each claims the first slot of its permutation that is still free, until none is left.  A row hashes to a slot and so
finds its shard in constant time; when a shard joins or leaves, few slots change hands.  The table has a fixed size,
whatever the data, so it is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production values: slots (a prime, over 100 a shard) and shards.
SLOTS = 8191
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position in ``shards`` of the shard that owns it.

    Names must differ and ``slots`` be a prime of at least as many.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if slots < max(2, len(shards)) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, not below the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for s in range(len(shards)):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from the first 15 hex digits of the md5 of its text (null: of the empty text)."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (the position of the shard); columns of those names are replaced.

    Rows are placed one by one, without a shuffle; equal keys share a shard, null keys go where the empty text goes.
    An empty table stays empty.
    """
    names = shard_names() if shards is None else shards
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(names, slots))), "loom_slot int, loom_shard int")
    # columns go by number meanwhile, so that no name can clash
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    rest = [F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns) if c not in ("slot", "shard")]
    placed = numbered.withColumn("loom_at", slot_of(F.col(f"c{df.columns.index(key)}"), slots)).join(
        F.broadcast(table), F.col("loom_at") == F.col("loom_slot"), "left"
    )
    return placed.select(*rest, F.col("loom_at").alias("slot"), F.col("loom_shard").alias("shard"))
