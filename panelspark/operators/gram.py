"""Gram matrices, the shared sufficient statistic, and everything linear that follows from them.

A Gram table is long: (group, i, j, value) over the design (1, features..., y); it holds all weighted
sums of squares and products. One scan makes it; fits, searches over penalties, leaving entities out,
ablations and prefixes are then sums and small solutions, independent of the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import saved, ship_code
from .ranks import group_percentiles


def gram(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, group: str | None = None) -> DataFrame:
    """(group, i, j, value), i <= j, of the design 1, features, y; rows with a NULL in it are left out.

    Each task sums its rows per group and the sums meet in one aggregation: a group costs the square
    of the columns per task, whatever its rows."""
    ship_code(df.sparkSession)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    g = F.lit("all") if group is None else F.col(group).cast("string")
    names = [*features, y]
    rows = df.select(g.alias("g"), w.alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    n = len(names) + 1
    upper = np.triu_indices(n)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf.iloc[:, 2:].to_numpy()])
            wx = x * pdf["w"].to_numpy()[:, None]
            code, values = pd.factorize(pdf["g"], sort=True)
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(values) + 1))
            for i, name in enumerate(values):
                at = order[cut[i] : cut[i + 1]]
                part = (x[at].T @ wx[at])[upper]
                held[name] = held[name] + part if name in held else part
            if len(held) * len(upper[0]) > 2_000_000:
                yield _long(held, upper)
                held = {}
        if held:
            yield _long(held, upper)

    return rows.mapInPandas(sums, "g string, i int, j int, value double").groupBy("g", "i", "j").agg(F.sum("value").alias("value"))


def _long(held: dict[str, np.ndarray], upper: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    k = len(upper[0])
    return pd.DataFrame({"g": np.repeat(list(held), k), "i": np.tile(upper[0], len(held)), "j": np.tile(upper[1], len(held)), "value": np.concatenate(list(held.values()))})


def square(rows: pd.DataFrame, n: int) -> np.ndarray:
    """The symmetric matrix of one group's (i, j, value)."""
    out = np.zeros((n, n))
    out[rows["i"], rows["j"]] = rows["value"]
    return out + np.triu(out, 1).T


def grams_by_group(table: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Matrices on the driver: groups times the square of the columns, so for a few groups, as splits are."""
    return {g: square(rows, n) for g, rows in table.toPandas().groupby("g")}


def _of(made: dict[str, np.ndarray], group: str, n: int) -> np.ndarray:
    """A group's matrix, of zeros if it has no rows."""
    return made[group] if group in made else np.zeros((n, n))


def solve(matrix: np.ndarray, alpha: float = 0.0, use: Sequence[int] | None = None) -> np.ndarray:
    """Intercept and coefficients of ridge regression with an unpenalised intercept; 0 for features not used.

    The features are centred first; without a penalty the minimal-norm solution is taken."""
    k = len(matrix) - 2
    use = list(range(k)) if use is None else list(use)
    n = matrix[0, 0]
    out = np.zeros(k + 1)
    if n <= 0:
        return out
    at = [u + 1 for u in use]
    mean, my = matrix[0, at] / n, matrix[0, -1] / n
    xx = matrix[np.ix_(at, at)] - n * np.outer(mean, mean)
    xy = matrix[at, -1] - n * mean * my
    beta = np.linalg.solve(xx + alpha * np.eye(len(at)), xy) if alpha > 0 else np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy
    out[at] = beta
    out[0] = my - mean @ beta
    return out


@dataclass(frozen=True)
class Linear:
    """A linear model over columns."""

    features: tuple[str, ...]
    beta: tuple[float, ...]

    def expression(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for c, b in zip(self.features, self.beta[1:], strict=True):
            out = out + float(b) * F.col(c)
        return out

    def transform(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        return df.withColumn(name, self.expression())


def ridge_fit(df: DataFrame, features: Sequence[str], y: str, alpha: float, weight: str | None = None) -> Linear:
    """Weighted ridge regression, minimising the weighted squares plus alpha times the coefficients' squares."""
    n = len(features) + 2
    matrix = _of(grams_by_group(gram(df, features, y, weight), n), "all", n)
    return Linear(tuple(features), tuple(float(b) for b in solve(matrix, alpha)))


def squares(matrix: np.ndarray, beta: np.ndarray) -> tuple[float, float, float]:
    """n, sum of squared errors and total squares of a model on the rows of a Gram matrix."""
    v = np.append(-beta, 1.0)
    n = matrix[0, 0]
    return n, float(v @ matrix @ v), float(matrix[-1, -1] - matrix[0, -1] ** 2 / n) if n else 0.0


def _scores(matrix: np.ndarray, beta: np.ndarray) -> tuple[float | None, float | None]:
    n, sse, sst = squares(matrix, beta)
    return (float((max(sse, 0) / n) ** 0.5) if n else None), (float(1 - sse / sst) if sst > 1e-9 else None)


def search_alpha(df: DataFrame, features: Sequence[str], y: str, alphas: Sequence[float], split: str = "split", weight: str | None = None) -> DataFrame:
    """(alpha, rmse_train, rmse_validation, rmse_test, best): all penalties from one scan. The first of the
    least validation errors wins; only the winner's test error is given. The errors of a split without rows
    are NULL, and without validation rows none is best."""
    n = len(features) + 2
    made = grams_by_group(gram(df, features, y, weight, split), n)
    train, test = _of(made, "train", n), _of(made, "test", n)
    betas = [solve(train, a) for a in alphas]
    validation = [_scores(_of(made, "validation", n), b)[0] for b in betas]
    best = int(np.argmin(validation)) if None not in validation and len(alphas) else None
    rows = [(float(a), _scores(train, b)[0], v, _scores(test, b)[0] if i == best else None, i == best) for i, (a, b, v) in enumerate(zip(alphas, betas, validation, strict=True))]
    return df.sparkSession.createDataFrame(rows, "alpha double, rmse_train double, rmse_validation double, rmse_test double, best boolean")


def _prefix_fits(df: DataFrame, features: Sequence[str], y: str, alpha: float, k: str, tick: str, steps: int, split: str) -> tuple[list[tuple[float, np.ndarray, np.ndarray]], np.ndarray]:
    """(fraction, Gram matrix, coefficients) of the fit on each prefix of the entities' train rows, and the matrix of
    the validation rows. A row's bucket is the first prefix that holds it; the buckets' matrices are added up."""
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy(k, split).orderBy(tick))
    n = F.count(F.lit(1)).over(W.partitionBy(k, split))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(steps)), lambda s: F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * s / steps))))
    bucket = F.when(F.col(split) == "train", first.cast("string")).when(F.col(split) == "validation", "validation")
    rows = df.withColumns({"_r": r, "_n": n}).withColumn("_b", bucket).filter(F.col("_b").isNotNull())
    size = len(features) + 2
    made = grams_by_group(gram(rows, features, y, None, "_b"), size)
    total, fits = np.zeros((size, size)), []
    for s in range(1, steps + 1):
        total = total + _of(made, str(s), size)
        fits.append((s / steps, total, solve(total, alpha)))
    return fits, _of(made, "validation", size)


def learning_curve(df: DataFrame, features: Sequence[str], y: str, alpha: float, k: str, tick: str, steps: int = 5, split: str = "split") -> DataFrame:
    """(fraction, n, rmse_train, rmse_validation) of fits on growing prefixes of each entity's train rows. Errors of
    splits without rows are NULL."""
    fits, validation = _prefix_fits(df, features, y, alpha, k, tick, steps, split)
    out = [(f, int(m[0, 0]), _scores(m, beta)[0], _scores(validation, beta)[0]) for f, m, beta in fits]
    return df.sparkSession.createDataFrame(out, "fraction double, n long, rmse_train double, rmse_validation double")


def learning_curve_by_entity(df: DataFrame, features: Sequence[str], y: str, alpha: float, k: str, tick: str, steps: int = 5, split: str = "split") -> DataFrame:
    """(fraction, entity, n, rmse, r2) of learning_curve's fits on the validation rows of each entity that has any.

    Each entity's matrix is scored in a task; r2 is NULL for a constant target."""
    df = saved(df.select(*dict.fromkeys([k, tick, split, *features, y])), "rows")  # what made df runs once
    fits, _ = _prefix_fits(df, features, y, alpha, k, tick, steps, split)
    size = len(features) + 2

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        own = square(pdf, size)
        rows = [(f, pdf["g"].iloc[0], int(own[0, 0]), *_scores(own, beta)) for f, _, beta in fits]
        return pd.DataFrame(rows, columns=["fraction", "entity", "n", "rmse", "r2"]).astype({"rmse": float, "r2": float})

    table = gram(df.filter(F.col(split) == "validation"), features, y, None, k)
    return table.groupBy("g").applyInPandas(scored, "fraction double, entity string, n long, rmse double, r2 double")


def leave_one_entity_out(df: DataFrame, features: Sequence[str], y: str, alpha: float, k: str, min_rows: int = 30, weight: str | None = None) -> DataFrame:
    """(entity, n, rmse, r2) of the ridge fitted on all other entities, exactly: all less the entity's matrix. Errors are
    weighted as the fit is.

    The matrices are summed once and saved; only the sum of all comes to the driver, and each entity's is solved in a task.
    Entities below min_rows (of weight) are in the others' fits only."""
    n = len(features) + 2
    table = saved(gram(df, features, y, weight, k), "grams")
    total = square(table.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas(), n)

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        own = square(pdf, n)
        keep = slice(0, int(own[0, 0] >= min_rows))
        rmse, r2 = _scores(own, solve(total - own, alpha))
        return pd.DataFrame({"entity": pdf["g"].iloc[:1], "n": [int(round(own[0, 0]))], "rmse": [rmse], "r2": [r2]}).astype({"rmse": float, "r2": float})[keep]

    return table.groupBy("g").applyInPandas(solved, "entity string, n long, rmse double, r2 double")


def left_out_predictions(df: DataFrame, features: Sequence[str], y: str, alpha: float, k: str, min_rows: int = 30, weight: str | None = None) -> DataFrame:
    """(entity, model, y_true, y_pred) for each row of each entity of min_rows rows at least: "ridge" is fitted on all
    other entities, "network_mean" is their weighted mean. Rows with a NULL in features, y or weight are left out.

    Each entity's coefficients are a row, from its own Gram matrix and the sum of all, and meet its rows by the entity."""
    n = len(features) + 2
    used = dict.fromkeys([*features, y, k, *([weight] if weight else [])])
    rows = saved(df.dropna(subset=[*used]).select(*used), "rows")  # what made df runs once
    table = saved(gram(rows, features, y, weight, k), "grams")
    total = square(table.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas(), n)

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = total - square(pdf, n)
        mean = rest[0, -1] / rest[0, 0] if rest[0, 0] > 0 else None
        return pd.DataFrame({"entity": pdf["g"].iloc[:1], "beta": [solve(rest, alpha).tolist()], "mean": [mean]}).astype({"mean": float})

    large = rows.groupBy(F.col(k).cast("string").alias("entity")).count().filter(F.col("count") >= min_rows).select("entity")
    betas = saved(table.groupBy("g").applyInPandas(solved, "entity string, beta array<double>, mean double").join(large, "entity"), "betas")
    ridge = F.col("beta")[0]
    for i, c in enumerate(features):
        ridge = ridge + F.col("beta")[i + 1] * F.col(c)
    made = F.inline(F.array(F.struct(F.lit("ridge").alias("model"), ridge.alias("y_pred")), F.struct(F.lit("network_mean").alias("model"), F.col("mean").alias("y_pred"))))
    met = rows.withColumn("entity", F.col(k).cast("string")).join(betas, "entity")
    return met.select("entity", F.col(y).cast("double").alias("y_true"), made)


def summarise_left_out(predictions: DataFrame, reference: str = "network_mean") -> DataFrame:
    """Of each model of (entity, model, y_true, y_pred): entities, mean, median, worst and best r2 over them, how many beat the
    reference model (NULL for itself), and pooled_rmse, pooled_mae and pooled_r2 over all rows."""
    from .evaluate import evaluate

    scores = saved(evaluate(predictions, ["entity", "model"]), "left-out")
    base = scores.filter(F.col("model") == reference).select("entity", F.col("r2").alias("_base"))
    both = scores.join(base, "entity", "left").groupBy("model").agg(
        F.count("*").alias("entities"), F.avg("r2").alias("mean_r2"), F.min("r2").alias("worst_r2"), F.max("r2").alias("best_r2"), F.count_if(F.col("r2") > F.col("_base")).alias("n_better")
    )
    both = both.withColumn("n_better", F.when(F.col("model") != reference, F.col("n_better")))
    median = group_percentiles(scores, "model", "r2", [0.5]).select("model", F.col("q")[0].alias("median_r2"))
    pooled = evaluate(predictions, ["model"]).select("model", *[F.col(c).alias(f"pooled_{c}") for c in ("rmse", "mae", "r2")])
    return both.join(median, "model", "left").join(pooled, "model")


def without(inverse: np.ndarray, beta: np.ndarray, gone: Sequence[int]) -> np.ndarray:
    """Ridge coefficients after columns go, 0 for those, from the inverse of all columns' penalised products."""
    gone = list(gone)
    out = beta - inverse[:, gone] @ np.linalg.solve(inverse[np.ix_(gone, gone)], beta[gone])
    out[gone] = 0.0
    return out


def ablation_removals(families: dict[str, Sequence[str]], unions: dict[str, Sequence[str]] | None = None, parts: dict[str, Sequence[str]] | None = None, excepting: dict[str, tuple[str, str]] | None = None) -> dict[str, list[str]]:
    """Name -> columns that go: each family; unions, name -> families or other unions; excepting, name -> (union, part): the union's columns
    but the part's; parts, name -> columns."""
    out = {name: list(columns) for name, columns in families.items()}
    for name, members in (unions or {}).items():
        out[name] = list(dict.fromkeys(c for m in members for c in out[m]))
    for name, (union, part) in (excepting or {}).items():
        out[name] = [c for c in out[union] if c not in (parts or {})[part]]
    return out | {name: list(columns) for name, columns in (parts or {}).items()}


def ablation(
    df: DataFrame, families: dict[str, Sequence[str]], y: str, alpha: float, weight: str | None = None, split: str = "split",
    unions: dict[str, Sequence[str]] | None = None, parts: dict[str, Sequence[str]] | None = None, excepting: dict[str, tuple[str, str]] | None = None, added: Sequence[str] = (),
) -> DataFrame:
    """(variant, n_features, rmse and r2 of validation and test, and their changes against full): without each family, union, part of one,
    union but a part (see ablation_removals); without weights; with the columns that pruning took (added). A column counts
    once, whatever has it; a variant that leaves no column is the mean. Errors of splits without rows are NULL.

    One scan makes the Gram matrices of all columns: of the train rows with weights, and of each split. The full model's
    penalised products are inverted once, and each removal is an update of as many columns as go."""
    removals = ablation_removals(families, unions, parts, excepting)
    own = list(dict.fromkeys(c for cs in families.values() for c in cs))
    extra = [c for c in dict.fromkeys(added) if c not in own]
    features, k = [*own, *extra], len(own)
    size = len(features) + 2
    rows = df.withColumns({"_one": F.lit(1.0)})
    doubled = F.explode(F.array(F.struct(F.col(split).alias("_part"), F.col("_one").alias("_w")), *([F.struct(F.lit("fitted").alias("_part"), F.when(F.col(split) == "train", F.col(weight).cast("double")).alias("_w"))] if weight else [])))
    made = grams_by_group(gram(rows.withColumn("_pw", doubled).select("*", "_pw._part", "_pw._w"), features, y, "_w", "_part"), size)
    plain = _of(made, "train", size)
    fitted = _of(made, "fitted", size) if weight else plain
    full = solve(fitted, alpha, range(k))
    n = fitted[0, 0]
    inverse = np.zeros((k, k))
    if alpha > 0 and n > 0:
        mean = fitted[0, 1 : k + 1] / n
        inverse = np.linalg.inv(fitted[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean) + alpha * np.eye(k))

    def left(gone: list[int]) -> np.ndarray:
        if not (alpha > 0 and n > 0):
            return solve(fitted, alpha, [i for i in range(k) if i not in gone])
        out = np.zeros(size - 1)
        out[1 : k + 1] = without(inverse, full[1 : k + 1], gone)
        out[0] = fitted[0, -1] / n - fitted[0, 1 : k + 1] / n @ out[1 : k + 1]
        return out

    variants = {"full": (full, k)}
    for name, columns in removals.items():
        gone = [own.index(c) for c in dict.fromkeys(columns) if c in own]
        variants[f"minus {name}"] = (left(gone), k - len(gone))
    if weight:
        variants["no weights"] = (solve(plain, alpha, range(k)), k)
    if extra:
        variants["no pruning"] = (solve(fitted, alpha), len(features))
    found = {name: [v for s in ("validation", "test") for v in _scores(_of(made, s, size), beta)] for name, (beta, _) in variants.items()}
    change = lambda a, b: None if a is None or b is None else a - b
    out = [(name, variants[name][1], *values, *[change(v, f) for v, f in zip(values, found["full"], strict=True)]) for name, values in found.items()]
    names = ["rmse_validation", "r2_validation", "rmse_test", "r2_test", "change_validation", "change_r2_validation", "change_test", "change_r2_test"]
    return df.sparkSession.createDataFrame(out, "variant string, n_features int, " + ", ".join(f"{c} double" for c in names))
