"""Sharding by a keyed permutation of global row numbers.

The rows are numbered 0 .. n - 1 in the order of given columns.  A Feistel network over
the smallest even number of bits that holds n - 1, walked along its cycle until
it lands below n, permutes these numbers; row p of the permuted order is slot
p // shards of shard p % shards.  So shards differ by one row at most, slots have no
gaps, the same rows and seed give the same shuffle on any cluster, and
``place_of`` and ``row_at`` tell a row's place, and a place's row, without a table.

Numbering is one range sort.  Equal rows are told apart by where they stand in a stored
copy, so that a key with a third of all rows is spread over many ranges, and a
lost executor's ranges come out the same.

Defined cases: nulls sort first.  Repeated rows are numbered one after the other and dealt like
any others.  An empty table has no places.  Columns of the rows that are called like an
added one (row_number, shard, slot) are replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, stored

SHARDS, SEED, ROUNDS = 24, 2026, 6
_LOW31 = (1 << 31) - 1


def half_bits(total: int) -> int:
    """Bits of each half of the smallest even-sized block that holds total - 1; halves have 31 at most."""
    return max(1, ((total - 1).bit_length() + 1) // 2)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Two odd factors and a summand below 2**31 for each round."""
    keys = []
    for k in range(rounds):
        a, b, c = np.frombuffer(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:12], "<u4").tolist()
        keys.append((a & _LOW31 | 1, b & _LOW31, c & _LOW31 | 1))
    return keys


def _round(r: np.ndarray, key: tuple[int, int, int], mask: int) -> np.ndarray:
    a, b, c = key
    t = (r * a + b) & _LOW31  # all products stay below 2**62
    t ^= t >> 15
    t = (t * c) & _LOW31
    return (t ^ t >> 16) & mask


def _network(x: np.ndarray, half: int, keys: list[tuple[int, int, int]], back: bool) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _round(left, key, mask), left
        else:
            left, right = right, left ^ _round(right, key, mask)
    return left << half | right


def permuted(numbers: np.ndarray, total: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Where the permutation of 0 .. total - 1 takes each number; ``back`` undoes it."""
    half, keys = half_bits(total), round_keys(seed)
    out = _network(np.asarray(numbers, dtype=np.int64), half, keys, back)
    while (outside := np.flatnonzero(out >= total)).size:  # every cycle that enters comes back below total
        out[outside] = _network(out[outside], half, keys, back)
    return out


def place_of(number: int, total: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permuted(np.array([number]), total, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, total: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a place."""
    p = slot * shards + shard
    if not (0 <= shard < shards and 0 <= p < total):
        raise ValueError(f"no slot {slot} in shard {shard}")
    return int(permuted(np.array([p]), total, seed, back=True)[0])


def _with(rows: DataFrame, **added) -> DataFrame:
    """The columns in ``whole`` but for those of the added names, and the added ones."""
    kept = [c for c in rows.schema["whole"].dataType.names if c not in added]
    return rows.select(*(F.col("whole")[c].alias(c) for c in kept), *(v.alias(k) for k, v in added.items()))


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(whole, number) of each row, and how many there are."""
    tied = stored(carried(rows, [F.col(f"`{c}`") for c in order]).withColumn("tie", F.monotonically_increasing_id()), "tied")
    along = [f"k{i}" for i in range(len(order))] + ["tie"]
    lined = stored(tied.repartitionByRange(*along).sortWithinPartitions(*along).select("whole", F.monotonically_increasing_id().alias("place")), "lined")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)  # Spark puts the partition's number above 33 bits of row numbers
    counts = sorted(tuple(r) for r in lined.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())  # one row a range
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    table = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return lined.withColumn("part", part.cast("long")).join(F.broadcast(table), "part").select("whole", (F.col("start") + within).alias("number")), total


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with row_number (from 0) in the order of some columns."""
    lined, _ = _numbered(rows, order)
    return _with(lined, row_number=F.col("number"))


def shard_rows(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with row_number, shard (int) and slot."""
    lined, total = _numbered(rows, order)

    @F.pandas_udf("long")
    def dealt(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), total, seed))

    placed = lined.withColumn("p", dealt("number"))
    return _with(placed, row_number=F.col("number"), shard=(F.col("p") % shards).cast("int"), slot=F.expr(f"p div {int(shards)}"))


def write_shards(rows: DataFrame, order: list[str], path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes the rows as Parquet to path/shard=K; names of a shard's files, and rows in them, ascend with slot."""
    placed = shard_rows(rows, order, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
