"""Sharding by a permutation-filled lookup table (operator 2).

Every shard has its own permutation of the slots of a table whose size is
prime.  Shards take turns: each claims the first slot of its permutation that
is still free, until the table is full, so shares differ by one slot at most.
A key's slot is its hash modulo the table size and its shard is what the table
holds there: one lookup per row.  When a shard goes, almost all slots of the
others stay where they are.

The table has ``size`` rows whatever the input, and is broadcast.  Placement
is a map over the rows without a shuffle, so hot keys do not gather anywhere.
``write_shards`` deals a shard's rows to files of bounded size.

A null key goes to the slot of the hash of nulls, as any other key: each row
has a shard.  Repeated keys share a shard.  Columns not kept are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime number of slots; some hundred times the shards keeps shares even.
SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n ** 0.5) + 1))


def _number(text: str, salt: str) -> int:
    import hashlib
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, salt=salt.encode()).digest(), "big")


def fill_table(shards: list[str], size: int = SLOTS) -> list[int]:
    """Shard number of every slot; shards claim slots in turn, each in its own order of preference."""
    if not _prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("the table needs a prime size and different shards, no more of them than slots")
    slots = [-1] * size
    place = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    free = size
    while free:
        for i in range(len(shards)):
            at = place[i]
            while slots[at] >= 0:
                at = (at + skip[i]) % size
            slots[at] = i
            place[i] = (at + skip[i]) % size
            free -= 1
            if not free:
                break
    return slots


def lookup_table(spark: SparkSession, shards: list[str], size: int = SLOTS) -> DataFrame:
    """(slot, shard) of every slot: ``size`` rows."""
    rows = [(slot, shards[n]) for slot, n in enumerate(fill_table(shards, size))]
    return spark.createDataFrame(rows, "slot int, shard string")


def place(df: DataFrame, key: str, shards: list[str], keep: list[str], size: int = SLOTS) -> DataFrame:
    """The kept columns with ``slot`` and ``shard``."""
    keep = [c for c in keep if c not in ("slot", "shard")]
    rows = df.select(F.struct(*keep).alias("row"), F.pmod(F.xxhash64(F.col(key)), F.lit(size)).cast("int").alias("slot"))
    return rows.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot").select("row.*", "slot", "shard")


def write_shards(placed: DataFrame, path: str, tasks_per_shard: int, rows_per_file: int = 1_000_000) -> None:
    """Write a folder for each shard; a shard's rows are dealt to several tasks, and files hold ``rows_per_file`` at most."""
    deal = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(tasks_per_shard))
    (placed.repartition("shard", deal).write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path))
