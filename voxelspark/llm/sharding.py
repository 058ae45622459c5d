"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a permutation given by an offset and a
skip from the hash of its name. The shards take turns; each claims the first slot of its order that is still free. A
key's hash modulo the size names its slot. The table depends on the shard names alone, goes to every task as one
constant array, and placing a key is one array access. When a shard leaves, few keys of other shards move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table goes to every task, so its size is bounded.
MAX_TABLE = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = 65537, weights: Sequence[int] | None = None) -> list[int]:
    """Shard index of every slot. A shard of weight w claims w slots in each of its turns."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(size) or size > MAX_TABLE or size < len(shards):
        raise ValueError(f"the table size must be a prime of at least the number of shards and at most {MAX_TABLE}")
    weights = [1] * len(shards) if weights is None else list(weights)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("every shard needs a weight of at least 1")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    place = [int(d[:8], 16) % size for d in digests]
    skip = [int(d[8:16], 16) % (size - 1) + 1 for d in digests]
    table, left = [-1] * size, size
    while True:
        for shard, weight in enumerate(weights):
            for _ in range(weight):
                at = place[shard]
                while table[at] >= 0:
                    at = (at + skip[shard]) % size
                table[at] = shard
                place[shard] = (at + skip[shard]) % size
                left -= 1
                if not left:
                    return table


def key_slot(key: Column, size: int) -> Column:
    """Slot of a key: the first 32 bits of its MD5 modulo the size. A null key counts as an empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key_col: str, shards: Sequence[str], *, size: int = 65537, weights: Sequence[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds each row's slot and shard name.

    Null key: placed as the empty string. Ties and repeated rows: equal keys go to the same shard. An empty table
    stays empty. Other columns are kept; columns named as the results are replaced. No shuffle.
    """
    table = lookup_table(shards, size, weights)
    # A constant that the optimizer folds into one array, sent once with each stage.
    lookup = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    names = F.array(*[F.lit(x) for x in shards])
    slot = key_slot(F.col(key_col), size)
    return df.withColumn(slot_col, slot).withColumn(shard_col, F.get(names, F.get(lookup, F.col(slot_col))))
