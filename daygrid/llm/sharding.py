"""Consistent sharding with a permutation-filled lookup table."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table is broadcast; its size doesn't depend on the data.
LARGEST_TABLE = 1_000_003


def _hash(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The number of the shard that owns each slot.

    Every shard has an order of preference over all slots: a start and a step from its name, and the size is prime, so
    each order meets every slot once. In turns, each shard claims the first slot of its order that is still free. All
    shards end with equally many slots but for one, and when a shard goes, few slots change hands among the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _prime(size) or not len(shards) <= size <= LARGEST_TABLE:
        raise ValueError(f"the table's size has to be a prime from the number of shards to {LARGEST_TABLE}")
    owner = [-1] * size
    at = [_hash(f"start {s}") % size for s in shards]
    step = [_hash(f"step {s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    for turn in range(size):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % size
        owner[at[k]] = k
    return owner


def slot_of(*keys: Column, size: int) -> Column:
    """60 bits of the md5 of the keys as text, one line each (a null is empty), modulo the size."""
    text = F.concat_ws("\n", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str], size: int = 65_537, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Every row with its slot and the number of its shard: one hash and one probe of a broadcast table of `size` rows.

    Nothing is shuffled and rows with the same keys share a shard. A null key is an empty text, repeated rows are kept,
    an empty table stays empty. The two new columns must not clash with the table's.
    """
    if {slot, shard} & set(df.columns):
        raise ValueError(f"the table already has a column {slot} or {shard}")
    owners = ",".join(map(str, lookup_table(shards, size)))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias(slot, shard)).withColumn(shard, F.col(shard).cast("int"))
    placed = df.withColumn(slot, slot_of(*(F.col(f"`{k}`") for k in keys), size=size))
    return placed.join(F.broadcast(table), slot).select(*(F.col(f"`{c}`") for c in df.columns), slot, shard)


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, size: int = 65_537) -> None:
    """One folder per shard; each task appends to the shards it holds, so no shard passes through one task."""
    names = F.element_at(F.split(F.lit("\n".join(shards)), "\n"), F.col("shard") + 1)
    place(df, keys, shards, size).withColumn("shard", names).drop("slot").write.partitionBy("shard").parquet(path)
