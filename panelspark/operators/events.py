"""Natural experiments: days of an event against the days around it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_code
from .evaluate import drawn_number
from .gram import gram, grams_by_group
from .reshape import hold_control_columns
from .stats import average_rank, with_correlation_p


#: Levels of a dummy column at most.
LEVELS = 64
#: A column whose squares fall below this part of their size has no variation of its own.
_NONE_LEFT = 1e-9


def _dummies(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level of columns but the first."""
    names: list[str] = []
    for c in columns:
        levels = sorted(r[0] for r in df.select(c).distinct().filter(F.col(c).isNotNull()).limit(LEVELS + 1).collect())
        if len(levels) > LEVELS:
            raise ValueError(f"{c} has more than {LEVELS} levels: absorb it")
        made = {f"_d_{c}_{i}": F.when(F.col(c) == v, 1.0).when(F.col(c).isNotNull(), 0.0) for i, v in enumerate(levels) if i}
        df = df.withColumns(made) if made else df
        names += made
    return df, names


def first_coefficient(matrix: np.ndarray, size: np.ndarray) -> float:
    """The coefficient of the first column in least squares of the last one on all others, from their products about the means.

    The other columns are swept out one after the other; one without variation of its own (against its size, the
    products' diagonal before the means were taken off) is passed over. NaN if the first column has none left."""
    a = matrix.copy()
    for k in range(1, len(a) - 1):
        if a[k, k] > _NONE_LEFT * size[k]:
            a -= np.outer(a[:, k], a[k]) / a[k, k]
    return float(a[0, -1] / a[0, 0]) if a[0, 0] > _NONE_LEFT * size[0] else float("nan")


def event_effect(
    df: DataFrame, flag: str, covariates: Sequence[str], y: str, window: str, rounds: int = 200, seed: int = 0, logged: bool = True, entity: str | None = None, dummies: Sequence[str] = ()
) -> DataFrame:
    """(effect_pct, low, high, windows, rounds, n, entities): least squares of y on the flag, covariates, a constant for each
    entity and dummies (months, hours: LEVELS levels at most), with an interval from resampling event windows. logged: y is
    a logarithm and the effect is expm1 of the coefficient; else it is relative to the mean of y where flag is 0. Rows with a NULL in any
    of these are left out.

    Entities are absorbed: with m the times that a round draws a window, the products about the entities' means are the sum of m times
    each window's Gram matrix, less s s'/n of each entity, where s and n are its sums and rows over the windows, m times
    each. So rows are read twice, whatever the rounds, and an entity costs its sums by window in a task. The driver has the
    windows' Gram matrices, those of a calendar, as wide as covariates and dummies, and a coefficient a round. A column that a
    round leaves without variation of its own is passed over; rounds in which that is the flag count for no
    interval. Without rows the effect and its interval are NULL."""
    ship_code(df.sparkSession)
    used = [flag, *covariates, y, window, *dummies, *([entity] if entity else [])]
    rows, names = _dummies(df.dropna(subset=used), dummies)
    features = [flag, *covariates, *names]
    q = len(features) + 2
    made = grams_by_group(gram(rows, features, y, None, window), q)
    windows = sorted(made)
    schema = "effect_pct double, low double, high double, windows int, rounds int, n long, entities long"
    if not windows:
        return df.sparkSession.createDataFrame([(None, None, None, 0, rounds, 0, 0)], schema)
    picks = [[drawn_number(b, i, seed) % len(windows) for i in range(len(windows))] for b in range(1, rounds + 1)]
    times = np.vstack([np.ones(len(windows)), *[np.bincount(p, minlength=len(windows)) for p in picks]])  # the whole first
    place = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col(window).cast("string")).cast("int") - 1
    own = F.lit(0) if entity is None else F.col(entity)
    sums = rows.groupBy(own.alias("_e"), place.alias("w")).agg(F.array(F.count("*").cast("double"), *[F.sum(F.col(c).cast("double")) for c in (*features, y)]).alias("s"))
    per = sums.groupBy("_e").agg(F.collect_list(F.struct("w", "s")).alias("parts")).select("parts")  # a list as long as the windows

    def taken_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = np.zeros((rounds + 1, q, q)), 0
        for pdf in batches:
            count += len(pdf)
            for lo in range(0, len(pdf), 256):
                parts = pdf["parts"].iloc[lo : lo + 256]
                table = np.zeros((len(parts), len(windows), q))
                for i, entries in enumerate(parts):
                    for e in entries:
                        table[i, e["w"]] = e["s"]
                total = np.tensordot(times, table, axes=(1, 1))  # round, entity, sum
                n = total[:, :, :1]
                held += np.swapaxes(np.divide(total, n, out=np.zeros_like(total), where=n > 0), 1, 2) @ total
        if count:
            yield pd.DataFrame({"round": np.arange(rounds + 1), "entities": count, "held": [h.tobytes() for h in held]})

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["round"].iloc[0])
        whole = sum(t * made[w] for t, w in zip(times[b], windows, strict=True))
        about = whole - sum(np.frombuffer(h).reshape(q, q) for h in pdf["held"])
        return pd.DataFrame({"round": [b], "entities": [pdf["entities"].sum()], "coefficient": [first_coefficient(about[1:, 1:], np.diag(whole)[1:])]})

    found = per.mapInPandas(taken_off, "round int, entities long, held binary").groupBy("round").applyInPandas(solved, "round int, entities long, coefficient double").toPandas()
    found = found.sort_values("round")
    total = sum(made.values())
    n, control = total[0, 0], total[0, 0] - total[0, 1]
    base = (total[0, -1] - total[1, -1]) / control if control > 0 else np.nan
    effect = 100 * (np.expm1(found["coefficient"].to_numpy()) if logged else found["coefficient"].to_numpy() / base)
    usable = effect[1:][~np.isnan(effect[1:])]
    low, high = np.percentile(usable, [2.5, 97.5]) if len(usable) else (np.nan, np.nan)
    value = lambda v: None if np.isnan(v) else float(v)
    return df.sparkSession.createDataFrame([(value(effect[0]), value(low), value(high), len(windows), rounds, int(round(n)), int(found["entities"].iloc[0]))], schema)


def event_by_entity(df: DataFrame, k: str, flag: str, columns: Sequence[str]) -> DataFrame:
    """Means of each entity without and with the event, and the change in per cent (NULL from 0)."""
    out = hold_control_columns(df, [k], F.col(flag), columns)
    return out.withColumns({f"{c}_pct": F.when(F.col(f"{c}_control") != 0, 100 * (F.col(f"{c}_event") - F.col(f"{c}_control")) / F.col(f"{c}_control")) for c in columns})


def event_profile(df: DataFrame, k: str, slot: str, flag: str, column: str, ratio: float = 0.6) -> DataFrame:
    """Of each slot: mean over entities of the change in per cent, entities, and whether few rows are behind it."""
    cells = hold_control_columns(df, [k, slot], F.col(flag), [column]).filter(F.col(f"{column}_control") != 0)
    cells = cells.withColumn("_pct", 100 * (F.col(f"{column}_event") - F.col(f"{column}_control")) / F.col(f"{column}_control"))
    rows = df.groupBy(slot).agg(F.count("*").alias("n_rows"))
    median = rows.agg(F.percentile("n_rows", 0.5).alias("_m"))
    out = cells.groupBy(slot).agg(F.avg("_pct").alias("mean_pct"), F.count("*").alias("entities")).join(rows, slot).join(F.broadcast(median))
    return out.withColumn("is_thin", F.col("n_rows") < ratio * F.col("_m")).drop("_m")


def dose_response(df: DataFrame, x: str, y: str, subset: str, limit: float) -> DataFrame:
    """(subset, n, r, p, rho, rho_p, slope) of y on x for all entities and for those with subset <= limit; from 3 entities on."""
    both = df.withColumn("subset", F.explode(F.when(F.col(subset) <= limit, F.array(F.lit("all"), F.lit("near"))).otherwise(F.array(F.lit("all"))))).dropna(subset=[x, y])
    ranked = average_rank(average_rank(both, x, ["subset"], "_rx", "_t"), y, ["subset"], "_ry", "_t")
    out = ranked.groupBy("subset").agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.corr("_rx", "_ry").alias("rho"), F.regr_slope(y, x).alias("slope")).filter("n >= 3")
    out = with_correlation_p(out)
    spearman = with_correlation_p(out.select("subset", "n", F.col("rho").alias("r"))).select("subset", F.col("p").alias("rho_p"))
    return out.join(spearman, "subset")
