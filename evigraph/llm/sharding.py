"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots. Every shard has its own order of all slots, a start and a step drawn from its
name; the shards take turns, each claiming the first slot in its order that is still free, so shards hold equal
parts to within one slot and a shard more or less moves few keys. A key's slot is its hash modulo the
table's size: placing a row is one hash and one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest table that is broadcast: about 40 MB.
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def slots_for(shards: int, each: int = 100) -> int:
    """The smallest prime of at least ``each`` slots for every shard."""
    n = max(3, shards * each)
    while not is_prime(n):
        n += 1
    return n


def digest(text: str) -> int:
    """The first 52 bits of MD5, which SQL engines can compute too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def fill(names: list[str], size: int) -> list[int]:
    """The owner of each slot, as a place in ``names``. Depends on names and size alone, not on data."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be distinct, and at least one")
    if not is_prime(size) or size < len(names) or size > MOST_SLOTS:
        raise ValueError(f"the table needs a prime size from the number of shards to {MOST_SLOTS}")
    at = [digest(f"offset:{n}") % size for n in names]
    step = [digest(f"skip:{n}") % (size - 1) + 1 for n in names]
    owner, turn = [-1] * size, 0
    for _ in range(size):
        k = turn % len(names)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % size
        owner[at[k]] = k
        turn += 1
    return owner


def shard(docs: DataFrame, shards: int | list[str], *, key_col: str = "doc_id", size: int | None = None) -> DataFrame:
    """Place every row: ``key_col, slot, shard``.

    ``shards`` are names, or a number for ``shard-0, shard-1, ...``; the table has ``size`` slots, by default the first
    prime of 100 slots a shard. The broadcast table has that many rows and no more, whatever the input. There is no
    shuffle, so a hot key costs nothing here.

    Cases: a null key is placed as empty text; equal keys always meet in one shard; other columns are not read; no rows,
    no result.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    size = size or slots_for(len(names))
    owner = ",".join(map(str, fill(names, size)))
    spark = docs.sparkSession
    owners = F.split(F.lit(owner), ",")
    labels = F.array(*[F.lit(n) for n in names])
    table = spark.range(size).select(F.col("id").alias("slot"), F.get(labels, F.get(owners, F.col("id").cast("int")).cast("int")).alias("shard"))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    rows = docs.select(F.col(key_col), (hashed % size).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select(key_col, "slot", "shard")


def oracle(shards: int, size: int) -> str:
    """The same in DuckDB SQL, the table filled by a recursive query that takes one turn at a time."""
    return f"""
WITH RECURSIVE names AS (
  SELECT i, ('0x' || substr(md5('offset:shard-' || i), 1, 13))::BIGINT % {size} AS off, ('0x' || substr(md5('skip:shard-' || i), 1, 13))::BIGINT % {size - 1} + 1 AS skip
  FROM (SELECT unnest(range({shards})) AS i)
), turns AS (
  SELECT 0::BIGINT AS turn, -1::BIGINT AS slot, list_transform(range({size}), lambda x: false) AS taken
  UNION ALL
  SELECT turn + 1, pick, list_concat(list_append(taken[:pick], true), taken[pick + 2:])
  FROM (SELECT turn, taken, (off + list_filter(range({size}), lambda j: NOT taken[(off + j * skip) % {size} + 1])[1] * skip) % {size} AS pick
        FROM turns JOIN names ON i = turn % {shards} WHERE turn < {size})
), filled AS (SELECT slot, 'shard-' || ((turn - 1) % {shards}) AS shard FROM turns WHERE slot >= 0)
SELECT doc_id, slot, shard FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT % {size} AS slot FROM documents) JOIN filled USING (slot)
"""
