"""Aggregations and statistics. NULLs are ignored; groups with a NULL key are left out where the docstring says so."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distributions import normal_two_sided, t_two_sided
from ..shipping import saved, ship_code
from .ranks import group_percentiles, literal, percentiles


def daily_rollup(df: DataFrame, keys: Sequence[str], columns: Sequence[str], sum_patterns: Sequence[str]) -> DataFrame:
    """Sums of columns whose name has a pattern, means of the others; NULL keys are left out."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    summed = lambda c: any(p.lower() in c.lower() for p in sum_patterns)
    return df.groupBy(*keys).agg(*[(F.sum(c) if summed(c) else F.avg(c)).alias(c) for c in columns])


def directional_summary(df: DataFrame, keys: Sequence[str], direction: str, value: str, directions: Sequence[str]) -> DataFrame:
    """Per key: total, directions, both-ways flag, largest share, imbalance (0 for one direction), share of each."""
    per = df.groupBy(*keys, direction).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_v"))
    share = lambda x: F.when(F.col("total") == 0, 0.0).otherwise(x / F.col("total"))
    sums = [F.coalesce(F.sum(F.when(F.col(direction) == d, F.col("_v"))), F.lit(0.0)).alias(f"_{d}") for d in directions]
    out = per.groupBy(*keys).agg(F.sum("_v").alias("total"), F.count("*").alias("n_directions"), F.max("_v").alias("_max"), F.min("_v").alias("_min"), *sums)
    return out.select(
        *keys, "total", "n_directions", (F.col("n_directions") >= 2).cast("int").alias("is_bidirectional"),
        share(F.col("_max")).alias("dominant_share"),
        F.when(F.col("n_directions") >= 2, share(F.col("_max") - F.col("_min"))).otherwise(0.0).alias("imbalance"),
        *[share(F.col(f"_{d}")).alias(f"share_{d}") for d in directions],
    )


def coverage_flag(df: DataFrame, k: str, y: str) -> DataFrame:
    """has_coverage: whether the entity has any y."""
    some = df.groupBy(k).agg(F.max(F.col(y).isNotNull()).alias("has_coverage"))
    return df.join(some, k)


def thin_slots(df: DataFrame, slot: Sequence[str], y: str, ratio: float = 0.6) -> DataFrame:
    """Share of rows with y in each slot, and whether it is below ratio times the median slot's."""
    shares = df.groupBy(*slot).agg(F.avg(F.col(y).isNotNull().cast("double")).alias("share"))
    median = shares.agg(F.percentile("share", 0.5).alias("_m"))
    return shares.join(F.broadcast(median)).withColumn("is_thin", F.col("share") < ratio * F.col("_m")).drop("_m")


def thin_entities(df: DataFrame, k: str, min_units: float = 90, scale: float = 1) -> DataFrame:
    counts = df.groupBy(k).agg(F.count("*").alias("n"))
    return counts.withColumn("is_thin", F.col("n") / scale < min_units)


def train_median(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """One row, one column: the exact median of the train rows, NULL if there are none."""
    (median,) = percentiles(df.filter(F.col(split) == "train"), {column: [0.5]})[column]
    return df.sparkSession.range(1).select(literal(median).alias(column))


def missing_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per cent of NULLs in each column before and after, to 0.01."""
    share = lambda df, name: df.agg(*[F.round(100 * F.avg(F.col(c).isNull().cast("double")), 2).alias(c) for c in columns]).unpivot([], list(columns), "column", name)
    return share(before, "before_pct").join(share(after, "after_pct"), "column")


def cleaning_ledger(df: DataFrame, entity: str, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step_order, step, rows_before, rows_after, rows_removed, entities_after) of steps that keep rows
    by their condition, one after the other, in one pass."""
    kept, alive = df, F.lit(True)
    names = []
    for i, (_, condition) in enumerate(steps):
        alive = alive & F.coalesce(condition, F.lit(False))
        kept = kept.withColumn(f"_k{i}", alive)
        names.append(f"_k{i}")
    per = kept.groupBy(entity).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in names])
    one = per.agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in names], *[F.count_if(F.col(c) > 0).alias(f"{c}e") for c in names])
    rows = [
        F.struct(F.lit(i + 1).alias("step_order"), F.lit(name).alias("step"), F.col("_n" if i == 0 else f"_k{i - 1}").alias("rows_before"),
                 F.col(f"_k{i}").alias("rows_after"), (F.col("_n" if i == 0 else f"_k{i - 1}") - F.col(f"_k{i}")).alias("rows_removed"), F.col(f"_k{i}e").alias("entities_after"))
        for i, (name, _) in enumerate(steps)
    ]
    return one.select(F.inline(F.array(*rows)))


def iqr_outliers(df: DataFrame, k: str, y: str, width: float = 1.5) -> DataFrame:
    """Quartiles, fences, and number and per cent of values outside them, per entity."""
    df = saved(df.select(k, y), "values")  # what made df runs once
    found = group_percentiles(df, k, y, [0.25, 0.75])
    spread = F.col("q")[1] - F.col("q")[0]
    found = found.select(k, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[0] - width * spread).alias("low"), (F.col("q")[1] + width * spread).alias("high"))
    q = df.select(k).distinct().join(saved(found, "quartiles"), k, "left")  # entities without values keep a row
    out = df.join(q, k).groupBy(k, "q1", "q3", "low", "high").agg(F.count(y).alias("n"), F.count_if((F.col(y) < F.col("low")) | (F.col(y) > F.col("high"))).alias("n_outliers"))
    return out.withColumn("pct_outliers", F.when(F.col("n") > 0, 100.0 * F.col("n_outliers") / F.col("n")))


def split_summary(df: DataFrame, split: str, k: str, t: str, y: str) -> DataFrame:
    per = df.groupBy(split, k).agg(F.count("*").alias("n"), F.stddev_samp(y).alias("within"))
    inner = per.groupBy(split).agg(F.count("*").alias("entities"), F.avg("within").alias("mean_within_sd"), F.avg("n").alias("rows_per_entity"))
    whole = df.groupBy(split).agg(F.count("*").alias("rows"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("sd_y"))
    return whole.join(inner, split)


def feature_inventory(features: DataFrame) -> DataFrame:
    """Per family of (feature, family, kept): candidates, pruned, kept, and the kept names joined by "; "."""
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("kept") == 1, F.col("feature")))), "; ")
    return features.groupBy("family").agg(F.count("*").alias("candidates"), F.count_if(F.col("kept") == 0).alias("pruned"), F.count_if(F.col("kept") == 1).alias("n_kept"), names.alias("names"))


def field_profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null, missing_pct, example) of every column, in one pass."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"n_{c}") for c in kinds], *[F.min(F.col(c).cast("string")).alias(f"e_{c}") for c in kinds])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n_{c}").alias("non_null"), F.round(100.0 * (F.col("_n") - F.col(f"n_{c}")) / F.col("_n"), 2).alias("missing_pct"), F.col(f"e_{c}").alias("example")) for c, t in kinds.items()]
    return one.select(F.inline(F.array(*rows)))


def normalised_profile(df: DataFrame, k: str, slot: str, value: str) -> DataFrame:
    """Mean of each slot in per cent of the entity's mean of slot means."""
    means = df.groupBy(k, slot).agg(F.avg(value).alias("mean"))
    return means.withColumn("pct", 100 * F.col("mean") / F.avg("mean").over(W.partitionBy(k)))


def monthly_rollup(df: DataFrame, t: str, means: Sequence[str], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    month = F.to_date(F.date_trunc("month", F.col(t))).alias("month")
    return df.groupBy(*by, month).agg(*[F.avg(c).alias(f"mean_{c}") for c in means], *[F.sum(c).alias(f"sum_{c}") for c in sums])


def entity_summary(df: DataFrame, k: str, means: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Means of columns, and an entity's attributes (constant within it; the smallest otherwise)."""
    return df.groupBy(k).agg(*[F.avg(c).alias(f"mean_{c}") for c in means], *[F.min(c).alias(c) for c in attributes])


def distribution_stats(df: DataFrame, y: str) -> DataFrame:
    """Count, mean, deviation, exact quartiles, population skewness and excess kurtosis."""
    quartiles = percentiles(df, {y: [0.25, 0.5, 0.75]})[y]
    out = df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.skewness(y).alias("skew"), F.kurtosis(y).alias("excess_kurtosis"))
    return out.select("n", "mean", "sd", *[literal(q).alias(c) for q, c in zip(quartiles, ("q1", "median", "q3"), strict=True)], "skew", "excess_kurtosis")


def boxplot_stats(df: DataFrame, k: str, y: str) -> DataFrame:
    """Quartiles, whiskers (farthest values within 1.5 quartile ranges) and the entity's place by median."""
    df = saved(df.select(k, y), "values")  # what made df runs once
    found = group_percentiles(df, k, y, [0.25, 0.5, 0.75]).select(k, *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    q = df.select(k).distinct().join(saved(found, "quartiles"), k, "left")  # entities without values keep a row
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    out = df.join(q, k).groupBy(k, "q1", "median", "q3").agg(F.min(F.when(F.col(y) >= low, F.col(y))).alias("whisker_low"), F.max(F.when(F.col(y) <= high, F.col(y))).alias("whisker_high"))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("median"), k)))  # one row an entity


def pearson_tests(df: DataFrame, variables: Sequence[str], y: str, alpha: float = 0.05) -> DataFrame:
    """Pairwise-complete correlation of each variable with y, its n and two-sided p."""
    both = lambda v: F.col(v).isNotNull() & F.col(y).isNotNull()
    one = df.agg(*[F.corr(F.when(both(v), F.col(v)), F.when(both(v), F.col(y))).alias(f"r_{v}") for v in variables], *[F.count_if(both(v)).alias(f"n_{v}") for v in variables])
    out = one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"r_{v}").alias("r"), F.col(f"n_{v}").alias("n")) for v in variables])))
    return with_correlation_p(out).withColumn("significant", F.col("p") < alpha)


def with_correlation_p(df: DataFrame) -> DataFrame:
    """p of a correlation r over n rows, two-sided; NULL below 3 rows."""
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return df.withColumn("p", F.when(F.col("n") >= 3, t_two_sided(t, (F.col("n") - 2).cast("double"))))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every two of columns, a before b, pairwise complete; NULL and NaN are missing. r is NULL
    below two complete rows and for columns that don't vary in them.

    Each task sums products of whole batches as matrices, of values less the column's mean, so that a pair
    costs one row a task, whatever the rows."""
    columns = list(columns)
    first, second = np.triu_indices(len(columns), 1)
    if not len(first):
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    ship_code(df.sparkSession)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = rows.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in rows.columns]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(names), len(first)))
        for pdf in batches:
            for lo in range(0, len(pdf), 10_000):
                x = pdf.iloc[lo : lo + 10_000].to_numpy(float, na_value=np.nan) - shift
                gone = np.isnan(x)
                if gone.any():
                    there = (~gone).astype(float)
                    x[gone] = 0
                    n, s, q = there.T @ there, x.T @ there, (x * x).T @ there  # [i, j]: of column i where j is there too
                else:
                    square = (len(columns), len(columns))
                    n, s, q = np.full(square, float(len(x))), *(np.broadcast_to(v[:, None], square) for v in (x.sum(0), (x * x).sum(0)))
                held += np.stack([m[first, second] for m in (n, s, s.T, q, q.T, x.T @ x)])
        yield pd.DataFrame({"i": np.arange(len(first)), **dict(zip(names, held, strict=True))})

    total = rows.mapInPandas(sums, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in names)
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    varies = (n > 1) & (va > 1e-12 * n * saa) & (vb > 1e-12 * n * sbb)
    name = lambda at: F.element_at(F.array(*map(F.lit, columns)), at + 1)
    pair = F.broadcast(df.sparkSession.createDataFrame(list(zip(range(len(first)), first.tolist(), second.tolist(), strict=True)), "i int, p int, q int"))
    r = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sab - sa * sb) / F.sqrt(va * vb))))
    return total.join(pair, "i").select(name(F.col("p")).alias("a"), name(F.col("q")).alias("b"), r.alias("r"))


def group_corr(df: DataFrame, k: str, x: str, y: str) -> DataFrame:
    """Per entity: correlation and the least-squares line of y on x."""
    return df.groupBy(k).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def corr_by_attribute(scores: DataFrame, attributes: DataFrame, k: str, r: str, attribute: str) -> DataFrame:
    """(groups, corr, slope, intercept): how the groups' correlations r go with an attribute of theirs, from one row a group in either
    table; groups without either value are left out. The line is r on the attribute."""
    both = scores.select(k, F.col(r).alias("_r")).join(attributes.select(k, F.col(attribute).alias("_a")), k).filter(F.col("_r").isNotNull() & ~F.isnan("_r") & F.col("_a").isNotNull())
    return both.agg(F.count("*").alias("groups"), F.corr("_r", "_a").alias("corr"), F.regr_slope("_r", "_a").alias("slope"), F.regr_intercept("_r", "_a").alias("intercept"))


def describe_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """Count, mean, sample deviation, least value, exact quartiles and largest value of column in each group that has any."""
    own = F.when(~F.isnan(column), F.col(column))
    sums = df.groupBy(group).agg(F.avg(own).alias("mean"), F.stddev_samp(own).alias("sd"), F.min(own).alias("least"), F.max(own).alias("largest"))
    quartiles = group_percentiles(df, group, column, [0.25, 0.5, 0.75])
    return quartiles.join(sums, group).select(group, "n", "mean", "sd", "least", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))], "largest")


def welch_t(df: DataFrame, y: str, flag: str) -> DataFrame:
    """Welch's t of y where flag is 1 against 0: (t, df, p, mean_1, mean_0)."""
    on, off = F.when(F.col(flag) == 1, F.col(y)), F.when(F.col(flag) == 0, F.col(y))
    one = df.agg(F.avg(on).alias("mean_1"), F.avg(off).alias("mean_0"), (F.var_samp(on) / F.count(on)).alias("_a"), (F.var_samp(off) / F.count(off)).alias("_b"), F.count(on).alias("_n1"), F.count(off).alias("_n0"))
    t = (F.col("mean_1") - F.col("mean_0")) / F.sqrt(F.col("_a") + F.col("_b"))
    freedom = F.pow(F.col("_a") + F.col("_b"), F.lit(2)) / (F.col("_a") * F.col("_a") / (F.col("_n1") - 1) + F.col("_b") * F.col("_b") / (F.col("_n0") - 1))
    out = one.withColumns({"t": t, "df": freedom})
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).select("mean_1", "mean_0", "t", "df", "p")


def within_group_change(df: DataFrame, k: str, flag: str, columns: Sequence[str]) -> DataFrame:
    """Of each column: median per cent change from flag 0 to 1 inside entities, Wilcoxon signed-rank W
    (the smaller sum) and its p by the normal approximation with the correction for ties."""
    means = df.groupBy(k).agg(*[F.avg(F.when(F.col(flag) == v, F.col(c))).alias(f"{c}_{v}") for c in columns for v in (0, 1)])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_0").alias("a"), F.col(f"{c}_1").alias("b")) for c in columns]))
    long = means.select(k, rows).dropna(subset=["a", "b"]).withColumns({"d": F.col("b") - F.col("a"), "pct": F.when(F.col("a") != 0, 100 * (F.col("b") - F.col("a")) / F.col("a"))})
    changes = long.groupBy("column").agg(F.count("*").alias("n"), F.percentile("pct", 0.5).alias("median_pct"))
    ranked = average_rank(long.filter("d <> 0").withColumn("_abs", F.abs("d")), "_abs", ["column"], "rank", "ties")
    ties = ranked.groupBy("column", "_abs").agg(F.first("ties").alias("m")).groupBy("column").agg(F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).alias("t"))
    sums = ranked.groupBy("column").agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("down"), F.count("*").alias("m"))
    sums = sums.join(ties, "column").withColumn("w", F.least("up", "down"))
    m = F.col("m")
    z = (F.col("w") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("t") / 48)
    return changes.join(sums.select("column", "w", normal_two_sided(z).alias("p")), "column", "left")


def average_rank(df: DataFrame, value: str, group: Sequence[str], rank: str, ties: str) -> DataFrame:
    """Ranks in which equal values share their mean, and how many share."""
    count = F.count(F.lit(1)).over(W.partitionBy(*group, value))
    return df.withColumns({ties: count, rank: F.rank().over(W.partitionBy(*group).orderBy(value)) + (count - 1) / 2})


def entity_roster(registry: DataFrame, splits: DataFrame, ledger: DataFrame, k: str) -> DataFrame:
    """Every registered entity: rows per split (0 if none), reason if excluded, role."""
    counts = splits.groupBy(k).agg(*[F.count_if(F.col("split") == s).alias(f"rows_{s}") for s in ("train", "validation", "test")])
    out = registry.join(counts, k, "left").join(ledger.select(k, "reason"), k, "left").fillna(0, [f"rows_{s}" for s in ("train", "validation", "test")])
    role = F.when(F.col("reason").isNotNull(), "excluded").when((F.col("rows_train") > 0) & (F.col("rows_test") > 0), "train + test").when(F.col("rows_train") > 0, "train only").otherwise("no rows")
    return out.withColumn("role", role)
