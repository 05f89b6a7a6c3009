"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOURS = [f"hour_{h:02d}" for h in range(24)]


def unpivot_hours(df: DataFrame, ids: Sequence[str], hours: Sequence[str] = HOURS, value: str = "volume") -> DataFrame:
    """A row for each hour column; hour NN ends at NN + 1."""
    long = df.unpivot(list(ids), list(hours), "_hour", value)
    return long.withColumn("hour_ending", F.regexp_extract("_hour", r"(\d+)$", 1).cast("int") + 1).drop("_hour")


def pivot_classes(df: DataFrame, index: Sequence[str], class_col: str, value: str, names: dict[str, str], missing_as_zero: bool = True) -> DataFrame:
    """Classes as columns, summed. A group of NULLs alone is 0 unless missing_as_zero is off; a class
    that a row of the index doesn't have is NULL."""
    total = F.sum(value)
    cells = df.groupBy(*index, class_col).agg((F.coalesce(total, F.lit(0.0)) if missing_as_zero else total).alias("_v"))
    wide = cells.groupBy(*index).pivot(class_col, list(names)).agg(F.first("_v"))
    return wide.withColumnsRenamed(names)


def pivot_metrics(df: DataFrame, row: Sequence[str], sets: Sequence[str], splits: Sequence[str], metric: str) -> DataFrame:
    """rows x (feature set, split), with the gaps between train and validation and between it and test."""
    cells = df.withColumn("_c", F.concat_ws("_", "feature_set", "split"))
    wide = cells.groupBy(*row).pivot("_c", [f"{s}_{p}" for s in sets for p in splits]).agg(F.first(metric))
    for s in sets:
        for a, b in zip(splits, splits[1:], strict=False):
            wide = wide.withColumn(f"{s}_{a}_minus_{b}", F.col(f"{s}_{a}") - F.col(f"{s}_{b}"))
    return wide


def hold_control_columns(df: DataFrame, keys: Sequence[str], flag: Column, columns: Sequence[str]) -> DataFrame:
    """Means where flag is 0 (control) and 1 (event) side by side; keys that lack one are dropped."""
    made = [F.avg(F.when(flag == v, F.col(c))).alias(f"{c}_{n}") for c in columns for v, n in ((0, "control"), (1, "event"))]
    return df.groupBy(*keys).agg(*made).dropna(subset=[f"{c}_{n}" for c in columns for n in ("control", "event")])


def sequence_windows(df: DataFrame, k: str, tick: str, features: Sequence[str], step: int, length: int) -> DataFrame:
    """For each row its `length - 1` exact earlier steps and itself, oldest first, as `sequence`, an
    array of (avail, x). A missing step has avail 0 and zeros. (k, tick) must be unique.

    A range frame of each entity's rows in order of tick, an integer, holds the steps: one exchange, one sort."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    past = W.partitionBy(k).orderBy(tick).rangeBetween(-(length - 1) * step, 0)
    entry = F.when(F.col(tick).isNotNull(), F.struct(F.col(tick).cast("long").alias("t"), x.alias("x")))  # collect_list skips NULL
    rows = df.withColumn("_m", F.map_from_entries(F.collect_list(entry).over(past)))
    zeros = F.array(*[F.lit(0.0)] * len(features))

    def place(j: int) -> Column:
        found = F.col("_m")[F.col(tick).cast("long") - j * step]
        return F.struct(F.when(found.isNull(), 0.0).otherwise(1.0).alias("avail"), F.coalesce(found, zeros).alias("x"))

    return rows.withColumn("sequence", F.array(*[place(j) for j in range(length - 1, -1, -1)])).drop("_m")
