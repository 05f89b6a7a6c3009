"""Tree models on MLlib, models on sequence windows, and a search over candidates."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..shipping import dealt, saved
from .evaluate import evaluate
from .gram import Linear, ablation_removals, ridge_fit


class Fitted:
    """An MLlib model over named columns."""

    def __init__(self, model, features: Sequence[str]):
        self.model, self.features = model, list(features)

    def transform(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        made = self.model.transform(VectorAssembler(inputCols=self.features, outputCol="_v", handleInvalid="keep").transform(df))
        return made.withColumn(name, F.col("prediction")).drop("_v", "prediction")


def _fit(estimator, df: DataFrame, features: Sequence[str], y: str, weight: str | None, *more: str) -> Fitted:
    """MLlib keeps the rows in as many parts as they come in: they are saved once, and dealt to as many tasks as they need."""
    kept = dict.fromkeys([*features, y, *([weight] if weight else []), *more])
    known = saved(df.dropna(subset=[*features, y]).select(*kept), "fit")
    if known.isEmpty():
        raise ValueError("no rows to fit a tree on")
    rows = VectorAssembler(inputCols=list(features), outputCol="_v").transform(dealt(known))
    estimator.setFeaturesCol("_v").setLabelCol(y)
    return Fitted((estimator.setWeightCol(weight) if weight else estimator).fit(rows), features)


def tree_fit(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, depth: int = 5, seed: int = 0) -> Fitted:
    return _fit(DecisionTreeRegressor(maxDepth=depth, seed=seed), df, features, y, weight)


def forest_fit(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, trees: int = 20, depth: int = 5, seed: int = 0) -> Fitted:
    return _fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), df, features, y, weight)


def gbt_fit(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, validation: str | None = None, rounds: int = 20, depth: int = 4, step: float = 0.1, seed: int = 0, sample: float = 0.8, columns: str = "0.8") -> Fitted:
    """Boosted trees. With validation, a boolean column, they stop when its rows' error stops falling.

    sample and columns: shares of rows a round and of columns a node, "all" for no sampling. There are no
    penalties on leaves: not the model of other boosting libraries."""
    estimator = GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=sample, featureSubsetStrategy=columns, seed=seed)
    return _fit(estimator.setValidationIndicatorCol(validation) if validation else estimator, df, features, y, weight, *([validation] if validation else []))


def tree_importance(fitted: Fitted, df: DataFrame) -> DataFrame:
    """(feature, importance) by impurity; 0 for unused features."""
    values = fitted.model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(fitted.features, values, strict=True)], "feature string, importance double")


def flatten_windows(df: DataFrame, features: Sequence[str], length: int, sequence: str = "sequence") -> tuple[DataFrame, list[str]]:
    """Columns s<i>_avail and s<i>_<feature> of each step of a sequence, the oldest first."""
    made = {}
    for i in range(length):
        made[f"s{i}_avail"] = F.col(sequence)[i]["avail"]
        made |= {f"s{i}_{c}": F.col(sequence)[i]["x"][j] for j, c in enumerate(features)}
    return df.withColumns(made), list(made)


def window_ridge(df: DataFrame, features: Sequence[str], y: str, length: int, alpha: float, train) -> tuple[Linear, DataFrame]:
    """A linear model on flattened sequence windows, fitted on the rows where train holds; and the rows with its columns."""
    rows, names = flatten_windows(df, features, length)
    return ridge_fit(rows.filter(train), names, y, alpha), rows


def candidates(space: dict[str, Sequence], required: Sequence[dict], trials: int, seed: int) -> list[dict]:
    """The required candidates and then random ones, without repeats, trials at most."""
    rng, out = random.Random(seed), []
    for c in required:
        if c not in out:
            out.append(dict(c))
    size = 1
    for values in space.values():
        size *= len(values)
    drawn: list[dict] = []
    while len(out) < trials and len(drawn) < size:
        c = {k: values[rng.randrange(len(values))] for k, values in sorted(space.items())}
        if c not in drawn:
            drawn.append(c)
            if c not in out:
                out.append(c)
    return out[: max(trials, len(required))]


def search(df: DataFrame, tried: Sequence[dict], fit: Callable[[DataFrame, dict], object], score: Callable[[DataFrame], float], split: str = "split") -> tuple[dict, DataFrame]:
    """Fit each candidate on train rows and score validation rows; the first of the least scores wins and is
    scored once on test rows. One row per candidate: (trial, parameters, validation, test, best). Without candidates, or if no
    score is a number, none is best: the first result is empty."""
    part = lambda s: df.filter(F.col(split) == s)
    models = [fit(part("train"), c) for c in tried]
    validation = [score(m.transform(part("validation"))) for m in models]
    known = [i for i, v in enumerate(validation) if v is not None and v == v]
    best = min(known, key=validation.__getitem__) if known else None
    rows = [(i, repr(sorted(c.items())), v, score(models[i].transform(part("test"))) if i == best else None, i == best) for i, (c, v) in enumerate(zip(tried, validation, strict=True))]
    return ({} if best is None else tried[best]), df.sparkSession.createDataFrame(rows, "trial int, parameters string, validation double, test double, best boolean")


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], in_flight: int = 4) -> list:
    """Results of jobs, in order, of which in_flight at most run at once: each starts Spark jobs of its own, which share the executors."""
    with ThreadPoolExecutor(max(1, in_flight)) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs]))


def leave_one_out(df: DataFrame, group: str, fits: dict[str, Callable[[DataFrame], object]], y: str, min_rows: int = 30, in_flight: int = 4) -> DataFrame:
    """(entity, model, y_true, y_pred) for each row of each group of min_rows rows at least: fits, name -> function of rows that
    returns a model, on all other groups, and "network_mean", the others' mean.

    One fit a group and model, in_flight at once, over one saved table; for models that, unlike ridge, have no sums to take a
    group from. Groups are a few hundred at most."""
    rows = saved(df.dropna(subset=[group, y]), "folds")
    sums = {r[group]: (r["n"], r["s"]) for r in rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s")).collect()}  # a row a group
    n, total = sum(c for c, _ in sums.values()), sum(s for _, s in sums.values())
    names = sorted(g for g, (c, _) in sums.items() if c >= min_rows and c < n)
    made = side_by_side(df.sparkSession, [lambda g=g, fit=fit: fit(rows.filter(F.col(group) != g)) for g in names for fit in fits.values()], in_flight)
    parts = []
    for i, g in enumerate(names):
        own = rows.filter(F.col(group) == g)
        held = [(name, made[i * len(fits) + j].transform(own, "_p")) for j, name in enumerate(fits)]
        held.append(("network_mean", own.withColumn("_p", F.lit((total - sums[g][1]) / (n - sums[g][0])))))
        parts += [p.select(F.col(group).cast("string").alias("entity"), F.lit(name).alias("model"), F.col(y).cast("double").alias("y_true"), F.col("_p").alias("y_pred")) for name, p in held]
    if not parts:
        return df.sparkSession.createDataFrame([], "entity string, model string, y_true double, y_pred double")
    return reduce(DataFrame.unionByName, parts)


def ablation(df: DataFrame, families: dict[str, Sequence[str]], fit: Callable[[DataFrame, list[str]], object], y: str, split: str = "split", in_flight: int = 4, **more) -> DataFrame:
    """(variant, n_features, split, n, rmse, mae, r2, change_rmse, change_r2) of validation and test rows, without each family, union, part or
    union but a part, as gram.ablation has them, of any model: one fit a variant, in_flight at once, over one saved table."""
    removals = ablation_removals(families, **more)
    own = list(dict.fromkeys(c for cs in families.values() for c in cs))
    variants = {"full": own} | {f"minus {n}": [c for c in own if c not in cs] for n, cs in removals.items() if set(own) - set(cs)}
    rows = saved(df, "variants")
    made = side_by_side(df.sparkSession, [lambda cs=cs: fit(rows.filter(F.col(split) == "train"), cs) for cs in variants.values()], in_flight)
    held = rows.filter(F.col(split).isin("validation", "test"))
    parts = [m.transform(held, "y_pred").select(F.lit(v).alias("variant"), F.lit(len(variants[v])).alias("n_features"), split, F.col(y).alias("y_true"), "y_pred") for v, m in zip(variants, made, strict=True)]
    scores = evaluate(reduce(DataFrame.unionByName, parts), ["variant", "n_features", split])
    full = scores.filter("variant = 'full'").select(split, F.col("rmse").alias("_rmse"), F.col("r2").alias("_r2"))
    return scores.join(F.broadcast(full), split).withColumns({"change_rmse": F.col("rmse") - F.col("_rmse"), "change_r2": F.col("r2") - F.col("_r2")}).drop("_rmse", "_r2")  # full: a row a split
