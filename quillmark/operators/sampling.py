"""Deterministic halves and samples: decided by hashes of ids, never by partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _hash(seed: int, key: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def halves(docs: DataFrame, group: str, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``docs`` with half 1 or 2: of each group's n documents the first (n + 1) / 2 in hash order are half 1.

    The rank is found from the counts of 4096 ranges of the hash and the order within a range, so that no task sorts a
    whole group.
    """
    h = docs.withColumn("__h", _hash(seed, key)).withColumn("__r", F.substring("__h", 1, 3))
    counts = h.groupBy(group, "__r").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__b", F.sum("__c").over(Window.partitionBy(group).orderBy("__r")) - F.col("__c")).withColumn("__n", F.sum("__c").over(Window.partitionBy(group)))
    placed = h.join(before, (h[group].eqNullSafe(before[group])) & (h["__r"] == before["__r"])).select(h["*"], "__b", "__n")
    rank = F.col("__b") + F.row_number().over(Window.partitionBy(group, "__r").orderBy("__h", key))
    return placed.withColumn("half", F.when(rank <= F.floor((F.col("__n") + 1) / 2), 1).otherwise(2)).drop("__h", "__r", "__b", "__n")


def subset(rows: DataFrame, limit: int, key: str, seed: int = 42) -> DataFrame:
    """``limit`` rows without replacement, the first in hash order; all, if there are no more."""
    return rows.orderBy(_hash(seed, key), key).limit(limit)


def fraction(rows: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """About that share of the rows, by hash."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def within_budget(sizes: list[tuple[int, int]], budget: int) -> list[int]:
    """Ids of ``(id, sentences)`` taken in turn while they fit; one that doesn't fit is passed over and later ones may."""
    taken, left = [], budget
    for i, n in sizes:
        if n <= left:
            taken.append(i)
            left -= n
    return taken


def java_shuffle(items: list, seed: int) -> list:
    """The order that the JVM's library shuffle gives for a seed: a 48-bit linear congruential generator."""
    state, out = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), list(items)

    def bits(n: int) -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        value = state >> (48 - n)
        return value - (1 << n) if n == 32 and value >= 1 << 31 else value

    def below(n: int) -> int:
        if n & (n - 1) == 0:
            return (n * bits(31)) >> 31
        while True:
            r = bits(31)
            value = r % n
            if r - value + n - 1 < 1 << 31:
                return value

    for i in range(len(out), 1, -1):
        j = below(i)
        out[i - 1], out[j] = out[j], out[i - 1]
    return out
