"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own (a permutation, s -> a s + b modulo the
prime, with a and b from the MD5 of its name). Shards take turns, each claiming the free slot that it prefers most,
until none is free; so all shards get the same number of slots, give or take one, and a shard that leaves or joins moves few
others' slots. A row's place is then one lookup, by a hash of its key, in a table of fixed size that is broadcast.
All of it is SQL: the turns are an `aggregate` over the slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: A prime, about a hundred slots a shard: shards' shares then differ by 1 %.
SLOTS = 6553
#: Filling takes time with the square of the slots; also the bound of what is broadcast.
MOST_SLOTS = 20_011


def _number(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _number_of(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for every slot; shards must be distinct and not more than slots, slots a prime."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards: distinct names, one at least, not more than slots")
    if not 2 <= slots <= MOST_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots: a prime up to {MOST_SLOTS}")
    m, n = F.lit(slots).cast("long"), len(shards)
    steps = F.lit([1 + _number_of(f"{s}:step") % max(1, slots - 1) for s in shards]).cast("array<bigint>")
    offsets = F.lit([_number_of(f"{s}:offset") % slots for s in shards]).cast("array<bigint>")

    def turn(state: Column, t: Column) -> Column:
        # a slot's place in the order, and the slot, in one number
        a, b = (F.get(x, (t % n).cast("int")) for x in (steps, offsets))
        first = F.array_min(F.transform(state["free"], lambda s: (a * s + b) % m * m + s)) % m
        claim = F.transform(F.array(first), lambda s: F.struct(F.array_remove(state["free"], s).alias("free"), F.concat(state["taken"], F.array(s)).alias("taken")))
        return F.get(claim, F.lit(0))

    every = F.sequence(F.lit(0).cast("long"), m - 1)
    start = F.struct(every.alias("free"), F.array().cast("array<bigint>").alias("taken"))
    claims = spark.range(1).select(F.posexplode(F.aggregate(every, start, turn)["taken"]).alias("t", "slot"))
    return materialize(claims.select("slot", F.get(F.lit(list(shards)), (F.col("t") % n).cast("int")).alias("shard")), "shards")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its MD5 modulo slots. Null has the slot of the empty text."""
    return _number(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(slots).cast("long")


def place(df: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """df with the slot and the shard of each row's key, in columns of the given names (which replace such columns).

    Equal keys share a shard, null counts as the empty text; no rows, no rows. No shuffle: the table has `slots` rows,
    however large df is, and is broadcast. Rows of a shard number as its keys' rows do: give a key that is spread."""
    slot, shard = names
    at, of = free_names(df, "slot", "shard")
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(at), F.col("shard").alias(of))
    rows = df.withColumn(at, slot_of(key, slots)).join(F.broadcast(table), at)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], F.col(at).alias(slot), F.col(of).alias(shard))


def write_shards(df: DataFrame, key: Column, path: str, files: int = 8, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Writes df as Parquet, a folder for each shard with up to `files` files: rows of a shard are dealt out to that
    many tasks, so that a hot shard is not one task's."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() != "map"]), F.lit(files))
    place(df, key, shards, slots).repartition("shard", salt).write.partitionBy("shard").parquet(path)
