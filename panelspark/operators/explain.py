"""What predictions rest on: linear and Shapley attributions, permutations, and tables made of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ROWS, saved
from .gram import Linear
from .permute import permuted, ranked
from .ranks import bins
from .stats import average_rank


def linear_attribution(df: DataFrame, model: Linear, row: str, keep: Sequence[str] = ()) -> DataFrame:
    """(row, feature, value, phi): coefficient times the value's distance from the mean, which sum to the
    prediction less the mean prediction."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in model.features])
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (float(b) * (F.col(c) - F.col(f"_m_{c}"))).alias("phi")) for c, b in zip(model.features, model.beta[1:], strict=True)]
    return df.join(F.broadcast(means)).select(row, *keep, F.inline(F.array(*parts)))


def family_shapley(df: DataFrame, model, families: dict[str, Sequence[str]], row: str) -> DataFrame:
    """(row, family, phi): exact Shapley values of feature families, against the row of all features' means.

    Every row meets the 2^m coalitions (m <= 7, at most 128), each a row in which absent families have their
    baseline; the model runs once over them, and weighted sums give the values. Sample rows beforehand."""
    m = len(families)
    rows = _coalitions(df, model, families, row)
    size = F.bit_count("_s")
    weight = lambda i: F.when(_inside(i), _weights(m, 1)[size]).otherwise(-_weights(m, 0)[size])
    sums = rows.groupBy(row).agg(*[F.sum(weight(i) * F.col("_v")).alias(f"phi_{i}") for i in range(m)])
    return sums.select(row, F.inline(F.array(*[F.struct(F.lit(n).alias("family"), F.col(f"phi_{i}").alias("phi")) for i, n in enumerate(families)])))


def family_interactions(df: DataFrame, model, families: dict[str, Sequence[str]], row: str) -> DataFrame:
    """(row, family_a, family_b, interaction): exact Shapley interaction index of each two families, the weighted
    mean, over coalitions of the others, of what both add together beyond what each adds alone.

    Coalitions are those of family_shapley; half of an index belongs to each of its families."""
    m = len(families)
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
    if not pairs:
        raise ValueError("at least 2 families")
    rows = _coalitions(df, model, families, row)

    def weighted(i: int, j: int):
        others = F.bit_count("_s") - _inside(i).cast("int") - _inside(j).cast("int")
        sign = F.when(_inside(i) == _inside(j), 1.0).otherwise(-1.0)
        return F.sum(sign * F.array(*[F.lit(math.factorial(s) * math.factorial(m - s - 2) / math.factorial(m - 1)) for s in range(m - 1)])[others] * F.col("_v"))

    sums = rows.groupBy(row).agg(*[weighted(i, j).alias(f"v_{i}_{j}") for i, j in pairs])
    names = list(families)
    parts = [F.struct(F.lit(names[i]).alias("family_a"), F.lit(names[j]).alias("family_b"), F.col(f"v_{i}_{j}").alias("interaction")) for i, j in pairs]
    return sums.select(row, F.inline(F.array(*parts)))


def interaction_table(interactions: DataFrame) -> DataFrame:
    """(family_a, family_b, mean_abs, share) of family_interactions."""
    out = interactions.groupBy("family_a", "family_b").agg(F.avg(F.abs("interaction")).alias("mean_abs"))  # a row a pair
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("mean_abs"), F.sum("mean_abs").over(W.partitionBy())), F.lit(0.0)))


def _inside(i: int):
    return F.col("_s").bitwiseAND(F.lit(1 << i)) != 0


def _coalitions(df: DataFrame, model, families: dict[str, Sequence[str]], row: str) -> DataFrame:
    """(row, _s, _v): the model's value for each coalition, whose families are the bits of _s."""
    m = len(families)
    if m > 7:
        raise ValueError("at most 7 families")
    features = [c for cs in families.values() for c in cs]
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    rows = df.select(row, *features).join(F.broadcast(means)).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1))))
    rows = rows.withColumns({c: F.when(_inside(i), F.col(c)).otherwise(F.col(f"_m_{c}")) for i, n in enumerate(families) for c in families[n]})
    return model.transform(rows, "_v").select(row, "_s", "_v")


def _weights(m: int, own: int):
    """Weight of a coalition of each size that has (own = 1) or lacks the family: s! (m - s - 1)! / m! of the others in it."""
    values = [math.factorial(s - own) * math.factorial(m - s + own - 1) / math.factorial(m) if 0 <= s - own <= m - 1 else 0.0 for s in range(m + 1)]
    return F.array(*[F.lit(v) for v in values])


def importance_table(phi: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(feature, mean_abs, share, direction, rank) of attributions; features that never vary in phi are left out.

    direction is the correlation of value and phi, 0 if either is constant."""
    out = phi.groupBy(*group, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.coalesce(F.corr("value", "phi"), F.lit(0.0)).alias("direction"), F.stddev_pop("value").alias("_sd"))
    out = out.filter("mean_abs > 0").withColumn("direction", F.when((F.col("_sd") > 0) & ~F.isnan("direction"), F.col("direction")).otherwise(0.0)).drop("_sd")
    all_ = W.partitionBy(*group)
    return out.withColumns({"share": F.col("mean_abs") / F.sum("mean_abs").over(all_), "rank": F.row_number().over(all_.orderBy(F.desc("mean_abs"), "feature"))})


def family_shares(importance: DataFrame, families: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(family, total, share, n_features, top_feature) from (feature, mean_abs) and (feature, family)."""
    out = importance.join(families, "feature").groupBy(*group, "family").agg(F.sum("mean_abs").alias("total"), F.count("*").alias("n_features"), F.max_by("feature", F.struct("mean_abs", "feature")).alias("top_feature"))
    return out.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy(*group)))


def effect_by_bins(effects: DataFrame, row: str, driver: str, modifier: str, sensor: str, deciles: int = 10, terciles: int = 3) -> DataFrame:
    """Mean, standard error and n of effect by bins of the driver and of the modifier. Rows without a sensor,
    a driver or a modifier are left out. row: distinct integers; equal values are binned in its order."""
    rows = effects.filter((F.col(sensor) == 1) & F.col(driver).isNotNull() & F.col(modifier).isNotNull())
    rows = saved(rows.select(*dict.fromkeys((row, driver, modifier, "effect"))), "effects")  # the passes of bins read it
    made = bins(rows, {driver: deciles, modifier: terciles}, row)
    rows = rows.withColumns({"driver_bin": made[driver], "modifier_bin": made[modifier]})
    return rows.groupBy("driver_bin", "modifier_bin").agg(F.avg("effect").alias("mean"), (F.stddev_samp("effect") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


def importance_by_group(phi: DataFrame, group: str, top: int = 10) -> DataFrame:
    """The top features inside each group."""
    return importance_table(phi, [group]).filter(F.col("rank") <= top)


def case_attributions(phi: DataFrame, cases: DataFrame, row: str, top: int = 10) -> DataFrame:
    """The largest contributions, by size, to each case (case, row)."""
    rows = phi.join(saved(cases.withColumnRenamed("row", row), "cases"), row)  # saved, Spark sees how few they are: phi isn't exchanged
    place = F.row_number().over(W.partitionBy("case").orderBy(F.desc(F.abs("phi")), "feature"))
    return rows.withColumn("place", place).filter(F.col("place") <= top)


def _exchanged(rows: DataFrame, n: int, columns: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """rows, ranked, once for each seed, as `repeat` from 0 on, with the columns of the row at the permuted rank."""
    to = F.inline(F.array(*[F.struct(F.lit(i).alias("repeat"), permuted(F.col("_rank"), n, seed).alias("_to")) for i, seed in enumerate(seeds)]))
    takers = rows.drop(*columns).select("*", to)
    return takers.join(rows.select(F.col("_rank").alias("_to"), *columns), "_to").drop("_to")


def shuffled(df: DataFrame, row: str, columns: Sequence[str], seed: int) -> DataFrame:
    """df with columns exchanged jointly between rows: each row gets those of the row whose place in the order of row is
    its own place, sent elsewhere by a keyed permutation of all places. row: distinct values."""
    rows, n = ranked(df, [row], "_rank")
    return _exchanged(rows, n, columns, [seed]).select(*df.columns)


def permutation_importance(df: DataFrame, model, groups: dict[str, Sequence[str]], row: str, y: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """(family, drop_mean, drop_sd): how much r2 falls when a family's columns are shuffled jointly over all rows, over repeats.

    Rows are ranked and saved once. All families and repeats are one join by rank, in tasks of a bounded number of rows: a row meets
    the one that a repeat sends it to, and each family takes its own columns from there. Give the columns that the model needs, as all of df's are joined."""
    from .evaluate import evaluate

    rows, n = ranked(df, [row], "_rank")

    def scored(rows: DataFrame) -> DataFrame:
        return model.transform(rows, "y_pred").select(F.col(y).alias("y_true"), "y_pred", *[c for c in ("family", "repeat") if c in rows.columns])

    whole = evaluate(scored(rows)).select(F.col("r2").alias("_whole"))
    moved = list(dict.fromkeys(c for columns in groups.values() for c in columns))
    to = F.inline(F.array(*[F.struct(F.lit(i).alias("repeat"), permuted(F.col("_rank"), n, seed + i).alias("_to")) for i in range(repeats)]))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * repeats // ROWS))
    givers = rows.select(F.col("_rank").alias("_to"), *[F.col(c).alias(f"_from_{c}") for c in moved]).repartition(tasks, "_to")
    met = rows.select("*", to).join(givers, "_to")
    families = [F.struct(F.lit(name).alias("family"), *[F.col(f"_from_{c}" if c in columns else c).alias(c) for c in moved]) for name, columns in groups.items()]
    parts = scored(met.select("repeat", *[c for c in df.columns if c not in moved], F.inline(F.array(*families))))
    found = evaluate(parts, ["family", "repeat"]).join(F.broadcast(whole))
    return found.withColumn("_d", F.col("_whole") - F.col("r2")).groupBy("family").agg(F.avg("_d").alias("drop_mean"), F.stddev_pop("_d").alias("drop_sd"))


def window_importance(df: DataFrame, model, features: Sequence[str], length: int, row: str, y: str, repeats: int = 3, seed: int = 0) -> DataFrame:
    """Permutation importance of each position of a sequence model's window, on flattened windows."""
    groups = {f"position {i}": [f"s{i}_avail", *[f"s{i}_{c}" for c in features]] for i in range(length)}
    return permutation_importance(df, model, groups, row, y, repeats, seed)


def rank_agreement(scores: DataFrame, min_families: int = 3) -> DataFrame:
    """Spearman correlation of each two methods of (method, family, value) over their common families."""
    left = scores.select(F.col("method").alias("a"), "family", F.col("value").alias("va"))
    right = scores.select(F.col("method").alias("b"), "family", F.col("value").alias("vb"))
    both = left.join(right, "family").filter("a < b AND va IS NOT NULL AND vb IS NOT NULL")
    ranked = average_rank(average_rank(both, "va", ["a", "b"], "ra", "_t"), "vb", ["a", "b"], "rb", "_t").drop("_t")
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho")).filter(F.col("n") >= min_families)
