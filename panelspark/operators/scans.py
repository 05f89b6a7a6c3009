"""Scans along entities of any length: in slices of the time axis, whose summaries compose.

A window of operators.windows is an entity in one task. Here an entity's ticks are cut into slices of one
width; each slice has a summary (number, sum and squares of values, last value), the summaries of the
slices before it, a row a slice, are added up, and this carry is joined back to the slice's rows. So an
entity that has all rows is the work of as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import saved


def _sliced(df: DataFrame, keys: Sequence[str], tick: str, width: int) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(tick) / width).cast("long"))


def _carried(rows: DataFrame, keys: Sequence[str], summaries: dict, carries: dict) -> DataFrame:
    """rows, sliced, with carries of what lies before their slice, from one row a slice."""
    parts = saved(rows.groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in summaries.items()]), "slices")
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), *[c.over(before).alias(n) for n, c in carries.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(carry, [*same, F.col("_slice") == F.col("_s")]).drop("_s", *[f"_k{i}" for i in range(len(keys))])


def _with_prior(df: DataFrame, keys: Sequence[str], tick: str, column: str, width: int) -> DataFrame:
    """df with _n, _sum and _sq of all earlier values of the keys, about the mean of all, _mean."""
    mean = saved(df.groupBy(*keys).agg(F.avg(column).alias("_mean")), "means")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = df.join(mean.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_mean"), same).drop(*[f"_k{i}" for i in range(len(keys))])
    x = F.col(column).cast("double") - F.col("_mean")
    rows = _sliced(rows.withColumn("_x", x), keys, tick, width)
    square = F.col("_x") * F.col("_x")
    rows = _carried(rows, keys, {"_n0": F.count("_x"), "_s0": F.sum("_x"), "_q0": F.sum(square)}, {f"_c{v}": F.sum(f"_{v}0") for v in "nsq"})
    own = W.partitionBy(*keys, "_slice").orderBy(tick).rowsBetween(W.unboundedPreceding, -1)
    made = {"_n": (F.count("_x"), "_cn"), "_sum": (F.sum("_x"), "_cs"), "_sq": (F.sum(square), "_cq")}
    rows = rows.withColumns({n: F.coalesce(c.over(own), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0)) for n, (c, carry) in made.items()})
    return rows.drop("_x", "_slice", "_cn", "_cs", "_cq")


def prior_expanding_of_slices(df: DataFrame, keys: Sequence[str], tick: str, column: str, width: int) -> DataFrame:
    """df with what windows.prior_expanding gives, in slices of width ticks. (keys, tick) must be unique."""
    rows = _with_prior(df, keys, tick, column, width)
    n, x = F.col("_n"), F.col(column)
    mean = F.when(n > 0, F.col("_mean") + F.col("_sum") / n)
    spread = F.col("_sq") - F.col("_sum") * F.col("_sum") / n
    sd = F.when(n >= 2, F.when(spread <= 1e-13 * F.col("_sq"), 0.0).otherwise(F.sqrt(spread / n)))
    rows = rows.withColumns({"prior_mean": mean, "prior_std": sd, "prior_available": (n > 0).cast("int")})
    mean, sd = F.col("prior_mean"), F.col("prior_std")
    return rows.withColumns({
        "prior_ratio": F.coalesce(F.when(mean != 0, x / mean), F.lit(1.0)),
        "prior_difference": F.coalesce(x - mean, F.lit(0.0)),
        "prior_z": F.coalesce(F.when(sd > 0, (x - mean) / sd), F.lit(0.0)),
    }).drop("_n", "_sum", "_sq", "_mean")


def slot_surprise_of_slices(df: DataFrame, keys: Sequence[str], tick: str, column: str, width: int, cap: float = 3.0) -> DataFrame:
    """df with surprise and has_slot, as windows.slot_surprise gives them, of keys (entity and slot) in slices of width ticks."""
    rows = _with_prior(df, keys, tick, column, width)
    mean = F.when(F.col("_n") > 0, F.col("_mean") + F.col("_sum") / F.col("_n"))
    raw = F.log1p(F.col(column)) - F.log1p(mean)
    surprise = F.coalesce(F.greatest(F.lit(-cap), F.least(F.lit(cap), raw)), F.lit(0.0))
    return rows.withColumns({"surprise": surprise, "has_slot": (F.col("_n") > 0).cast("int")}).drop("_n", "_sum", "_sq", "_mean")


def forward_fill_of_slices(df: DataFrame, keys: Sequence[str], tick: str, column: str, width: int, name: str, default: float = 0.0) -> DataFrame:
    """df with the last value so far as name, else default, and name_available, whether the row had one itself."""
    rows = _sliced(df, keys, tick, width)
    last = F.max_by(column, F.when(F.col(column).isNotNull(), F.col(tick)))
    rows = _carried(rows, keys, {"_last": last}, {"_before": F.last("_last", ignorenulls=True)})
    own = W.partitionBy(*keys, "_slice").orderBy(tick).rowsBetween(W.unboundedPreceding, 0)
    filled = F.coalesce(F.last(column, ignorenulls=True).over(own), F.col("_before"), F.lit(default))
    return rows.withColumns({name: filled, f"{name}_available": F.col(column).isNotNull().cast("int")}).drop("_slice", "_before")


def sequence_windows_of_slices(df: DataFrame, keys: Sequence[str], tick: str, features: Sequence[str], step: int, length: int, width: int) -> DataFrame:
    """df with sequence, as reshape.sequence_windows gives it, in slices of width ticks. A slice has the rows of its own and, as
    history, those of the slices before it that its windows reach."""
    from .reshape import sequence_windows

    reach = (length - 1) * step
    first, last = F.floor(F.col(tick) / width).cast("long"), F.floor((F.col(tick) + reach) / width).cast("long")
    rows = df.withColumn("_own", first).withColumn("_slice", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("_key", F.struct(*keys, "_slice"))
    made = sequence_windows(rows, "_key", tick, features, step, length)
    return made.filter("_own = _slice").drop("_own", "_slice", "_key")
