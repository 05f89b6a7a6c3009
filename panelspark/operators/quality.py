"""Checks. Each returns (check, violations); require() raises on any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All conditions counted in one pass."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "check", "violations")


def require(checked: DataFrame) -> None:
    bad = checked.filter("violations > 0").take(20)
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(F.count("*").alias("violations")).select(F.lit("repeated_key").alias("check"), "violations")


def check_source(df: DataFrame, target: str, drivers: Sequence[str], total: str, parts: Sequence[str], hour: str | None = None) -> DataFrame:
    """NULL targets, negative drivers, totals that aren't their parts within 1e-8, hours outside 1 to 24."""
    absent = [c for c in (target, total, *drivers, *parts, *([hour] if hour else [])) if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    negative = F.lit(False)
    for c in drivers:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    checks = {"null_target": F.col(target).isNull(), "negative_driver": negative, "total_off": F.abs(F.col(total) - sum((F.col(p) for p in parts), F.lit(0.0))) > 1e-8}
    if hour:
        checks["hour_range"] = ~F.col(hour).between(1, 24)
    return _counts(df, checks)


def check_output(df: DataFrame, numeric: Sequence[str], one_hot: dict[str, tuple[Sequence[str], bool]], shares: Sequence[str]) -> DataFrame:
    """NULLs, infinities, one-hot groups that don't sum to 1 (or 0 or 1 if a level was dropped), shares outside [0, 1]."""
    null = infinite = outside = F.lit(False)
    for c in numeric:
        null = null | F.col(c).isNull()
        infinite = infinite | F.coalesce(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(False))
    for c in shares:
        outside = outside | F.coalesce(~F.col(c).between(0, 1), F.lit(False))
    checks = {"null": null, "infinite": infinite, "share_range": outside}
    for name, (columns, dropped) in one_hot.items():
        total = sum((F.col(c) for c in columns), F.lit(0))
        checks[f"one_hot_{name}"] = ~(total.isin(0, 1) if dropped else total == 1)
    return _counts(df, checks)


def check_lag_leakage(df: DataFrame, k: str, tick: str, y: str, lag: str, available: str, step: int) -> DataFrame:
    """Lags marked available that aren't the target exactly one step earlier, found by an equality join."""
    past = df.select(k, (F.col(tick) + step).alias(tick), F.col(y).alias("_past"))
    wrong = (F.col(available) == 1) & ~F.col(lag).eqNullSafe(F.col("_past"))
    return _counts(df.join(past, [k, tick], "left"), {"lag_not_past_target": wrong})


def check_reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """Keys of one side only, and totals that differ by more than tolerance."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    return _counts(both, {"one_side": F.col("_a").isNull() != F.col("_b").isNull(), "different": F.abs(F.col("_a") - F.col("_b")) > tolerance})
