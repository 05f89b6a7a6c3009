"""Places of rows in an order, and keyed permutations of them, without a window over all rows.

A permutation of 0 .. n-1 is a Feistel network on the rectangle a x b that just holds n places: in turns
one side is added to a hash of the other, modulo its length. That is a bijection of the rectangle; a
place that it sends beyond n is sent on until it is inside, which makes it one of 0 .. n-1. Fewer than a
places lie beyond n, about the root of n, so that the driver follows them all and knows how many
steps the longest way takes. Hashes are md5, which SQL repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import saved

ROUNDS = 4


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank") -> tuple[DataFrame, int]:
    """df with each row's place from 0 on in the order, and the number of rows. The order's columns tell rows apart;
    equal rows have any order among them.

    Rows are range partitioned, sorted in their tasks and saved with their place there; the driver sees the number of
    rows of each task."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = saved(sorted_.withColumns({"_part": F.spark_partition_id(), name: inside}), "ranks")
    counts = sorted((r["_part"], r["n"]) for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, "_part int, _first long")  # a row a task
    return table.join(F.broadcast(first), "_part").withColumn(name, F.col(name) + F.col("_first")).drop("_part", "_first"), total


def sides(n: int) -> tuple[int, int]:
    """The rectangle of n places: a x b >= n, a x b < n + a."""
    a = max(isqrt(max(n, 1) - 1) + 1, 1)
    return a, -(-max(n, 1) // a)


def _hash(seed: int, turn: int, value: int) -> int:
    return int(hashlib.md5(f"{seed}:{turn}:{value}".encode()).hexdigest()[:15], 16)


def step(place: int, n: int, seed: int) -> int:
    """Where the network sends a place of the rectangle."""
    a, b = sides(n)
    left, right = divmod(place, b)
    for turn in range(ROUNDS):
        if turn % 2:
            right = (right + _hash(seed, turn, left)) % b
        else:
            left = (left + _hash(seed, turn, right)) % a
    return left * b + right


def steps_beyond(n: int, seed: int) -> int:
    """How many steps more than one any place of 0 .. n-1 takes at most."""
    a, b = sides(n)
    out = {p: step(p, n, seed) for p in range(n, a * b)}
    ends, most = set(out) - set(out.values()), 0
    for p in ends:  # the first place beyond n on a way; those on circles beyond n have no way in
        count = 1
        while (p := out[p]) >= n:
            count += 1
        most = max(most, count)
    return most


def permuted(place: Column, n: int, seed: int) -> Column:
    """The place in 0 .. n-1 that a place of 0 .. n-1 is sent to: a bijection, another one for each seed."""
    a, b = sides(n)

    def once(at: Column) -> Column:
        pair = F.struct(((at - F.pmod(at, F.lit(b))) / b).cast("long").alias("left"), F.pmod(at, F.lit(b)).cast("long").alias("right"))
        turns = F.array(*[F.lit(t) for t in range(ROUNDS)])

        def turn(held: Column, t: Column) -> Column:
            left, right = held["left"], held["right"]
            key = lambda side: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), t.cast("string"), side.cast("string"))), 1, 15), 16, 10).cast("long")
            odd = t % 2 == 1
            return F.struct(
                F.when(odd, left).otherwise(F.pmod(left + key(right), F.lit(a))).cast("long").alias("left"),
                F.when(odd, F.pmod(right + key(left), F.lit(b))).otherwise(right).cast("long").alias("right"),
            )

        return F.aggregate(turns, pair, turn, lambda held: held["left"] * b + held["right"])

    more = steps_beyond(n, seed)
    first = once(place.cast("long"))
    if not more:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(more)), first, lambda at, _: F.when(at < n, at).otherwise(once(at)))
