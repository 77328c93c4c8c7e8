"""Placement of keys on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """For each slot the index of its shard.

    Every shard has its own order of preference over the slots: it starts at an offset and goes on
    by a step, both from a hash of its name; as ``slots`` is prime, it visits each slot once. The
    shards take turns, and at its turn each takes the first slot in its order that is free, until
    none is. So shares differ by one slot at most, and a shard more or less moves few others.
    """
    if not is_prime(slots) or not 0 < len(shards) <= slots:
        raise ValueError("slots must be prime and there must be 1 to as many shards")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    whole = [int.from_bytes(hashlib.md5(s.encode()).digest(), "big") for s in shards]
    at = [h % slots for h in whole]
    step = [(h >> 64) % max(1, slots - 1) + 1 for h in whole]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 15 hex digits of the md5 of its text, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = 4099) -> DataFrame:
    """Add ``slot int`` and ``shard string`` to every row, by its key, without a shuffle.

    The table of ``slots`` entries, whose size does not depend on the data, goes to the tasks with
    the plan, and a row is placed by one look into it. A null key goes where the text ``null`` goes.
    Rows with equal keys go to one shard; an empty table stays empty. If ``df`` has columns named
    slot or shard, they are replaced.
    """
    table = lookup_table(shards, slots)
    names = F.array(*[F.lit(s) for s in shards])
    of_slot = F.array(*[F.lit(i) for i in table])
    slot = slot_of(df[key], slots)
    return df.withColumns({"slot": slot, "shard": names[of_slot[slot]]})


def write_shards(df: DataFrame, path: str, shards: list[str], key: str = "doc_id", slots: int = 4099, files: int = 1) -> None:
    """Write each shard to a folder of its own, ``files`` files each, rows dealt out by key within a shard."""
    placed = place(df, shards, key, slots)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    placed.repartition(len(shards) * files, "shard", part).write.partitionBy("shard").parquet(path)
