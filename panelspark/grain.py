"""Grain of a panel: what identifies a row, and its place on the time axis as an integer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    """Keys of a row, and a step on the time axis: days for daily panels, seconds for others, so that
    neither depends on a time zone's clock changes."""

    name: str
    entity: str
    time: str
    step: int

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.time]

    def tick(self) -> Column:
        """The time column as an integer in units of the axis."""
        if self.name == "daily":
            return F.datediff(F.col(self.time), F.lit("1970-01-01").cast("date")).cast("long")
        return F.unix_timestamp(F.col(self.time).cast("timestamp")).cast("long")


def daily(entity: str, date: str) -> Grain:
    return Grain("daily", entity, date, 1)


def hourly(entity: str, time: str) -> Grain:
    return Grain("hourly", entity, time, 3600)


def hour_ending_time(date: str, hour_ending: str) -> Column:
    """date + hour_ending hours; hour 24 is midnight of the next day."""
    return (F.unix_timestamp(F.col(date).cast("timestamp")) + F.col(hour_ending) * 3600).cast("timestamp")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes NULL, so that aggregates ignore it."""
    kinds = {"double", "float"}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])
