"""Forecasts that need no fit beyond means of the train rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import by_time


def _with_means(df: DataFrame, k: str, y: str, split: str) -> DataFrame:
    train = df.filter(F.col(split) == "train")
    return df.join(train.groupBy(k).agg(F.avg(y).alias("_entity")), k, "left").join(F.broadcast(train.agg(F.avg(y).alias("_all"))))


def persistence_baseline(df: DataFrame, k: str, tick: str, y: str, step: int, split: str = "split") -> DataFrame:
    """y_pred: y exactly one step earlier, else the entity's train mean, else that of all train rows."""
    past = F.first(y).over(by_time(k, tick).rangeBetween(-step, -step))
    return _with_means(df.withColumn("_past", past), k, y, split).withColumn("y_pred", F.coalesce("_past", "_entity", "_all")).drop("_past", "_entity", "_all")


def seasonal_climatology(df: DataFrame, k: str, season: Sequence[str], y: str, split: str = "split") -> DataFrame:
    """y_pred: train mean of the entity and season, with the same fallbacks."""
    cells = df.filter(F.col(split) == "train").groupBy(k, *season).agg(F.avg(y).alias("_cell"))
    return _with_means(df.join(cells, [k, *season], "left"), k, y, split).withColumn("y_pred", F.coalesce("_cell", "_entity", "_all")).drop("_cell", "_entity", "_all")


def network_mean(df: DataFrame, k: str, y: str, weight: str | None = None) -> DataFrame:
    """(entity, y_pred): weighted mean of all other entities' y: the totals less one's own sums."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    own = df.filter(F.col(y).isNotNull()).groupBy(k).agg(F.sum(w * F.col(y)).alias("_s"), F.sum(w).alias("_w"))
    total = own.agg(F.sum("_s").alias("_ts"), F.sum("_w").alias("_tw"))
    rest = F.col("_tw") - F.col("_w")
    return own.join(F.broadcast(total)).select(k, F.when(rest > 0, (F.col("_ts") - F.col("_s")) / rest).alias("y_pred"))
