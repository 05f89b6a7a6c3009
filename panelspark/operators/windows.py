"""Windows over time: exact lags, past-only rolling and expanding statistics, bins, top rows, samples.

tick is the time as an integer (Grain.tick). All of an entity's frames order by it, so one exchange
and one sort serve them together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..shipping import saved, ship_code
from .permute import ranked
from .ranks import literal, percentiles


def by_time(k: str | Sequence[str], tick: str) -> WindowSpec:
    return W.partitionBy(*([k] if isinstance(k, str) else k)).orderBy(tick)


def exact_lag(k: str, tick: str, column: str, delta: int) -> tuple[Column, Column]:
    """The value exactly delta earlier, 0 if there is none, and whether there was."""
    past = F.first(column).over(by_time(k, tick).rangeBetween(-delta, -delta))
    return F.coalesce(past, F.lit(0.0)), past.isNotNull().cast("int")


def lag_derivatives(value: Column, short: Column, short_available: Column, long: Column, long_available: Column) -> dict[str, Column]:
    """Change from the short lag, ratio to it (1 if it is 0 or not there), change between the lags."""
    there = short_available == 1
    return {
        "change": F.when(there, value - short).otherwise(0.0),
        "ratio": F.when(there & (short != 0), value / short).otherwise(1.0),
        "prior_change": F.when(there & (long_available == 1), short - long).otherwise(0.0),
    }


def time_rolling(k: str, tick: str, column: str, width: int, agg: str, min_periods: int) -> tuple[Column, Column]:
    """mean, std (population) or sum over [t - width, t), 0 below min_periods values, and whether there were enough."""
    frame = by_time(k, tick).rangeBetween(-width, -1)
    f = {"mean": F.avg, "std": F.stddev_pop, "sum": F.sum}[agg](column).over(frame)
    enough = F.count(column).over(frame) >= min_periods
    return F.when(enough, f).otherwise(0.0), enough.cast("int")


def rolling_features(df: DataFrame, k: str, tick: str, specs: dict[str, tuple[str, int, str, int]]) -> DataFrame:
    """df with, for each name -> (column, width, agg, min_periods), what time_rolling gives as name and name_available.

    Rows are dealt by entity and sorted by tick once; a task goes over them in batches and carries the rows on that later frames of an
    entity may reach. A frame over [t - width, t) is the difference of two that begin at the first of these, of counts, and of sums and squares
    about their mean, so that the time doesn't depend on the widths. A task holds no more than twice an entity's rows in the widest frame,
    and a batch. Differences that are within the sums' rounding of nothing are 0. A null tick has no frame and is in none. Columns of
    df that aren't needed should be dropped before."""
    columns = list(dict.fromkeys(c for c, _, _, _ in specs.values()))
    made = [StructField(n, t) for name in specs for n, t in ((name, DoubleType()), (f"{name}_available", IntegerType()))]
    passed = [f for f in df.schema.fields if f.name not in {m.name for m in made}]
    values = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    rows = df.select(*[F.col(f"`{f.name}`") for f in passed], F.col(k).alias("_k"), F.col(tick).cast("long").alias("_t"), *values)
    ship_code(df.sparkSession)
    rolled = partial(_rolled, specs=[(columns.index(c), width, agg, least) for c, width, agg, least in specs.values()], passed=len(passed))
    return rows.repartition("_k").sortWithinPartitions("_k", "_t").mapInArrow(rolled, StructType(passed + made))


def _rolled(batches: Iterator, specs: list[tuple[int, int, str, int]], passed: int) -> Iterator:
    """The first passed columns of batches sorted by _k and _t, and of each (place among _x, width, agg, min_periods) the value and whether there were enough."""
    import pyarrow as pa
    import pyarrow.compute as pc

    widest, many = max(width for _, width, _, _ in specs), max(i for i, _, _, _ in specs) + 1
    keys, ticks = [], np.zeros(0, np.int64)
    x, known = np.zeros((many, 0)), np.zeros((many, 0), bool)
    waiting, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            waiting.append(batch)
            size += batch.num_rows
        if not waiting or (batch is not None and size < len(ticks)):
            continue  # as many new rows as are carried on, so that a row is looked at twice or so
        table, old = pa.Table.from_batches(waiting), len(ticks)
        waiting, size = [], 0
        own = pa.concat_arrays([*keys, *table["_k"].chunks])
        ticks = np.concatenate((ticks, pc.fill_null(table["_t"], _NO_TICK).to_numpy()))
        x = np.concatenate((x, [table[f"_x{i}"].to_numpy() for i in range(many)]), axis=1)
        known = np.concatenate((known, [pc.is_valid(table[f"_x{i}"]).to_numpy() for i in range(many)]), axis=1)
        codes = own.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        made = _frames(ticks, x, known, first, specs, old)
        fields = [*table.columns[:passed], *(pa.array(column) for column in made)]
        yield from pa.Table.from_arrays(fields, [*table.column_names[:passed], *(f"_{i}" for i in range(len(made)))]).to_batches(max_chunksize=10_000)
        held = np.arange(first[-1], len(ticks))
        held = held[(ticks[held] != _NO_TICK) & (ticks[held] >= ticks[-1] - widest)] if ticks[-1] != _NO_TICK else held[:0]
        start = held[0] if len(held) else len(ticks)
        keys, ticks, x, known = [own[start:]], ticks[start:], x[:, start:], known[:, start:]


#: Stands for a null tick: sorts first, as nulls do.
_NO_TICK = -(2**63)


def _frames(ticks: np.ndarray, x: np.ndarray, known: np.ndarray, first: np.ndarray, specs: list[tuple[int, int, str, int]], old: int) -> list[np.ndarray]:
    """Of each spec the values and whether there were enough, for all rows but the first old ones. first: where entities begin."""
    n = len(ticks)
    size = np.diff(np.append(first, n))
    finite = known & np.isfinite(x)
    mean = np.add.reduceat(np.where(finite, x, 0.0), first, axis=1) / np.maximum(np.add.reduceat(finite.astype(float), first, axis=1), 1)
    mean = np.repeat(mean, size, axis=1)
    off = np.where(finite, x - mean, 0.0)
    parts = [known.astype(float), off, off * off]
    if not finite[known].all():
        parts += [(known & np.isnan(x)).astype(float), (known & (x == np.inf)).astype(float), (known & (x == -np.inf)).astype(float)]
    before = _before(np.stack(parts), first, size)
    begin = np.repeat(first, size)[old:]
    at = np.arange(old, n)
    no_tick = ticks[old:] == _NO_TICK
    bound = lambda width: np.where(no_tick, at, _bisect(ticks, begin, at, np.where(no_tick, 0, ticks[old:]) - width))
    high, low = bound(0), {width: bound(width) for width in {width for _, width, _, _ in specs}}
    sums, out = {}, []
    with np.errstate(all="ignore"):
        for i, width, agg, least in specs:
            if (i, width) not in sums:
                count, s, q, *odd = before[:, i, high] - before[:, i, low[width]]
                if odd:  # what sums of such values are
                    beyond = np.where(odd[0] > 0, np.nan, 0.0) + np.where(odd[1] > 0, np.inf, 0.0) - np.where(odd[2] > 0, np.inf, 0.0)
                    s, q = s + beyond, q + np.abs(beyond)
                sums[i, width] = count, s, q
            count, s, q = sums[i, width]
            m = mean[i, old:]
            if agg == "mean":
                value = m + s / count
            elif agg == "sum":
                value = s + count * m
            else:
                spread = q - s * s / count
                value = np.where(((count == 1) & np.isfinite(s)) | (spread <= 1e-13 * before[2, i, high]), 0.0, np.sqrt(spread / count))
            out += [np.where(count >= max(least, 1), value, 0.0), (count >= least).astype(np.int32)]
    return out


def _bisect(ticks: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place from low on, high at most, whose tick is wanted or later; sorted between the two."""
    while (low < high).any():
        middle = (low + high) // 2
        less = (low < high) & (ticks[middle] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return low


def _before(m: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Along the last axis, sums of what comes before each place in its own segment, none of which sees another's values."""
    out = np.zeros_like(m)
    level = np.ceil(np.log2(size)).astype(int)
    for v in np.unique(level):  # segments of like sizes side by side
        step = np.arange(1 << v)
        place, inside = first[level == v][:, None] + step, step < size[level == v][:, None]
        sums = np.cumsum(np.where(inside, m[..., np.minimum(place, m.shape[-1] - 1)], 0.0), axis=-1)
        out[..., place[:, 1:][inside[:, 1:]]] = sums[..., :-1][..., inside[:, 1:]]
    return out


def prior_expanding(k: str, tick: str, column: str) -> dict[str, Column]:
    """Mean (of 1 at least) and population deviation (of 2 at least) of all earlier rows, and against them
    the value's ratio (else 1), difference (else 0) and z-score (else 0)."""
    frame = by_time(k, tick).rowsBetween(W.unboundedPreceding, -1)
    n, mean, sd = F.count(column).over(frame), F.avg(column).over(frame), F.stddev_pop(column).over(frame)
    x = F.col(column)
    sd = F.when(n >= 2, sd)
    return {
        "prior_mean": mean, "prior_std": sd, "prior_available": (n > 0).cast("int"),
        "prior_ratio": F.coalesce(F.when(mean != 0, x / mean), F.lit(1.0)),
        "prior_difference": F.coalesce(x - mean, F.lit(0.0)),
        "prior_z": F.coalesce(F.when(sd > 0, (x - mean) / sd), F.lit(0.0)),
    }


def slot_surprise(k: str, slot: Sequence[str], tick: str, column: str, cap: float = 3.0) -> tuple[Column, Column]:
    """log1p of the value less log1p of the mean of earlier rows of the entity's slot, within ±cap; 0 if none."""
    mean = F.avg(column).over(by_time([k, *slot], tick).rowsBetween(W.unboundedPreceding, -1))
    raw = F.log1p(F.col(column)) - F.log1p(mean)
    return F.coalesce(F.greatest(F.lit(-cap), F.least(F.lit(cap), raw)), F.lit(0.0)), mean.isNotNull().cast("int")


def forward_fill(k: str, tick: str, column: str, default: float = 0.0) -> tuple[Column, Column]:
    """Last value so far, else default, and whether the row had one itself."""
    last = F.last(column, ignorenulls=True).over(by_time(k, tick).rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce(last, F.lit(default)), F.col(column).isNotNull().cast("int")


def row_rolling_mean(k: str, tick: str, column: str, n: int) -> Column:
    return F.avg(column).over(by_time(k, tick).rowsBetween(-(n - 1), 0))


def equal_bins(order: Sequence[str | Column], n: int, partition: Sequence[str] = ()) -> Column:
    """Bin 1 to n of the row's rank, cut at the quantiles of the ranks: sizes differ from ntile's. Without a partition, for
    small tables; equal_bins_of_all is for others."""
    group = W.partitionBy(*partition)
    r = F.row_number().over(group.orderBy(*order)).cast("long")
    total = F.count(F.lit(1)).over(group)
    return F.when(total <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil((r - 1) * n / (total - 1)))).cast("int")


def equal_bins_of_all(df: DataFrame, order: Sequence[str], n: int, name: str = "bin") -> DataFrame:
    """df with the bin, as equal_bins cuts them, of each row's place among all rows, without a window over them. The
    order's columns tell rows apart."""
    rows, total = ranked(df, order, "_place")
    return rows.withColumn(name, F.greatest(F.lit(1), F.ceil(F.col("_place") * n / max(total - 1, 1))).cast("int")).drop("_place")


def dedupe_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """The first or last row of each key in a total order."""
    by = [F.asc(c) if keep == "first" else F.desc(c) for c in order]
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter("_r = 1").drop("_r")


def rank_within(group: Sequence[str], value: str) -> Column:
    """1 for the largest; ties share the smallest rank."""
    return F.rank().over(W.partitionBy(*group).orderBy(F.desc(value)))


def prefix_fraction(df: DataFrame, k: str, tick: str, fraction: float) -> DataFrame:
    """The first max(1, ceil(n * fraction)) rows of each entity."""
    r, n = F.row_number().over(by_time(k, tick)), F.count(F.lit(1)).over(W.partitionBy(k))
    return df.withColumns({"_r": r, "_n": n}).filter(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))).drop("_r", "_n")


def sort_panel(df: DataFrame, k: str, tick: str) -> DataFrame:
    return df.orderBy(k, tick)


def top_k(df: DataFrame, value: str, n: int, tie: str, group: Sequence[str] = ()) -> DataFrame:
    """The n largest, of each group if given; ties by the smaller tie column."""
    by = [F.desc(value), F.asc(tie)]
    if not group:
        return df.orderBy(*by).limit(n)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*by))).filter(F.col("_r") <= n).drop("_r")


def top_models(scores: DataFrame, n: int, must_have: str) -> DataFrame:
    """Of each model its tuned row, else the default one; the n best by r2 and the mandatory model."""
    pick = W.partitionBy("model").orderBy(F.when(F.col("stage") == "tuned", 0).otherwise(1))
    best = scores.withColumn("_r", F.row_number().over(pick)).filter("_r = 1").drop("_r")
    order = W.orderBy(F.desc_nulls_last("r2"), "model")  # one row a model
    return best.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= n) | (F.col("model") == must_have))


def pick_cases(df: DataFrame, row: str, y: str, wind: str, subset: Column) -> DataFrame:
    """(case, row): largest y; y nearest the median; nearest the subset's median among its calm (wind at
    most its lower third) and windy (its upper third) rows. Ties go to the smaller row."""
    near = lambda m: F.min_by(row, F.struct(F.abs(F.col(y) - m), F.col(row)))
    df = saved(df.select(*dict.fromkeys((row, y, wind)), F.coalesce(subset, F.lit(False)).alias("_inside")), "cases")  # what made df runs once
    inside = F.col("_inside")
    marks = percentiles(df.select(F.col(y).alias("y"), F.when(inside, F.col(wind)).alias("wind")), {"y": [0.5], "wind": [1 / 3, 2 / 3]})
    median, (low, high) = literal(marks["y"][0]), map(literal, marks["wind"])
    calm, windy = inside & (F.col(wind) <= low), inside & (F.col(wind) >= high)
    centre = percentiles(df.select(F.when(calm, F.col(y)).alias("calm"), F.when(windy, F.col(y)).alias("windy")), {"calm": [0.5], "windy": [0.5]})
    rows = df
    picked = lambda c, m: F.min_by(F.when(c, F.col(row)), F.when(c, F.struct(F.abs(F.col(y) - m), F.col(row))))
    found = rows.agg(
        F.min_by(row, F.struct(-F.col(y), F.col(row))).alias("highest"), near(median).alias("typical"),
        picked(calm, literal(centre["calm"][0])).alias("calm"), picked(windy, literal(centre["windy"][0])).alias("windy"),
    )
    return found.unpivot([], ["highest", "typical", "calm", "windy"], "case", "row")


def sample_key(key: str, seed: int) -> Column:
    """A number below 2^60 from a hash of the key, whatever its type, and the seed, which any engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows without replacement, the first ones by the key's hash; the same ones whatever the partitions."""
    return df.orderBy(sample_key(key, seed), key).limit(n)


def set_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of the one column of a that b lacks, and the other way round, with their side."""
    left = a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("left"))
    return left.unionByName(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit("right")))
