"""Splits, scaling and selection of features, with statistics from the train rows alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import literal, percentiles
from .stats import corr_matrix


def split_cutoffs(df: DataFrame, t: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """One row: the days that the quantiles of the rows' times fall on."""
    micros = df.select(F.unix_micros(F.col(t).cast("timestamp")).alias("_t"))
    cuts = percentiles(micros, {"_t": [train, train + validation]})["_t"]
    day = lambda v: F.to_date(F.timestamp_micros(F.lit(None if v is None else int(v)).cast("long")))
    return df.sparkSession.range(1).select(day(cuts[0]).alias("cut_validation"), day(cuts[1]).alias("cut_test"))


def chrono_split(df: DataFrame, t: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """split: train, validation, test by one pair of days for all entities."""
    cuts = split_cutoffs(df, t, train, validation)
    day = F.to_date(F.col(t))
    named = F.when(day < F.col("cut_validation"), "train").when(day < F.col("cut_test"), "validation").otherwise("test")
    return df.join(F.broadcast(cuts)).withColumn("split", named).drop(*cuts.columns)


def impute_train_median(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """`<c>_available` says what was there; NULLs then get the exact median of the train rows, and stay if there is none."""
    medians = percentiles(df.filter(F.col(split) == "train"), {c: [0.5] for c in columns})
    out = df.withColumns({f"{c}_available": F.col(c).isNotNull().cast("int") for c in columns})
    return out.withColumns({c: F.coalesce(F.col(c), literal(medians[c][0])) for c in columns})


def dispersion_proxy(df: DataFrame, driver: str, wind: str, split: str = "split", name: str = "proxy") -> DataFrame:
    """log1p of the driver by one more than the wind, which is the train rows' median where it is NULL; NULL without either."""
    (median,) = percentiles(df.filter(F.col(split) == "train"), {wind: [0.5]})[wind]
    return df.withColumn(name, F.log1p(driver) / (1 + F.coalesce(F.col(wind), literal(median))))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_constant): at most one distinct value, NULL being one, from one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"n_{c}") for c in columns], *[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns])
    same = lambda c: (F.col(f"n_{c}") == 0) | ((F.col(f"n_{c}") == F.col("_n")) & (F.col(f"a_{c}") == F.col(f"b_{c}")))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(same(c), F.lit(True)).alias("is_constant")) for c in columns])))


def drop_constant(df: DataFrame, columns: Sequence[str], protected: Sequence[str] = ()) -> DataFrame:
    """df without constant columns. The schema depends on the data: this runs one aggregate."""
    found = [r["column"] for r in constant_columns(df, columns).filter("is_constant").collect()]  # a row a column
    return df.drop(*[c for c in found if c not in protected])


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_binary): whether all values, rounded to 6 places, are 0 or 1."""
    one = df.agg(*[F.coalesce(F.bool_and(F.round(F.col(c).cast("double"), 6).isin(0.0, 1.0)), F.lit(True)).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "is_binary")


def scaler(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """One row: mean and population deviation (1 if 0) of the train rows."""
    sd = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    return df.filter(F.col(split) == "train").agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns], *[sd(c).alias(f"_sd_{c}") for c in columns])


def standardise(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.join(F.broadcast(fitted))
    return out.withColumns({c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}") for c in columns}).drop(*fitted.columns)


def unscale(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.join(F.broadcast(fitted))
    return out.withColumns({c: F.col(c) * F.col(f"_sd_{c}") + F.col(f"_mean_{c}") for c in columns}).drop(*fitted.columns)


def prune_correlated(df: DataFrame, columns: Sequence[str], derived: Sequence[str] = ("lag", "roll", "prior"), limit: float = 0.95, split: str = "split") -> DataFrame:
    """(feature, kept, reason) from the train rows: constants go, and then, in the order of derived tokens
    in the name and position, a column whose absolute correlation with a kept one is above limit.

    Correlations are sums of matrices; the greedy pass is over the square of the columns, on the driver."""
    train = df.filter(F.col(split) == "train")
    constant = {r["column"] for r in constant_columns(train, columns).filter("is_constant").collect()}
    left = [c for c in columns if c not in constant]
    r = {(row["a"], row["b"]): row["r"] for row in corr_matrix(train, left).collect()} if len(left) > 1 else {}
    rank = {c: (sum(token in c for token in derived), i) for i, c in enumerate(columns)}
    kept: list[str] = []
    rows = [(c, 0, "constant") for c in constant]
    for c in sorted(left, key=rank.__getitem__):
        with_ = next((k for k in kept if abs(r.get((c, k), r.get((k, c))) or 0) > limit), None)
        if with_:
            rows.append((c, 0, f"correlated with {with_}"))
        else:
            kept.append(c)
            rows.append((c, 1, ""))
    return df.sparkSession.createDataFrame(rows, "feature string, kept int, reason string")


def prune_sets(df: DataFrame, sets: dict[str, Sequence[str]], derived: Sequence[str] = ("lag", "roll", "prior"), limit: float = 0.95, split: str = "split") -> DataFrame:
    """(set, feature, kept, reason): each set, as the exogenous and the autoregressive features, is pruned for itself."""
    out = None
    for name, columns in sets.items():
        part = prune_correlated(df, columns, derived, limit, split).select(F.lit(name).alias("set"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def feature_roles(df: DataFrame, target: str, weight: str | None, metadata: Sequence[str], trend: Sequence[str], autoregressive: Sequence[str], pruned: Sequence[str] = ()) -> DataFrame:
    """(feature, role) of every column: target, weight, metadata, trend, pruned, autoregressive (by prefix), exogenous."""
    rows = []
    for c in df.columns:
        role = "target" if c == target else "weight" if c == weight else "metadata" if c in metadata else "trend" if c in trend else "pruned" if c in pruned else "autoregressive" if c.startswith(tuple(autoregressive)) else "exogenous"
        rows.append((c, role))
    return df.sparkSession.createDataFrame(rows, "feature string, role string")


def drop_redundant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)
