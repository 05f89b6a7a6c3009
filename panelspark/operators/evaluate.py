"""Scores of predictions (y_true, y_pred) and comparisons of models."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import saved, ship_code
from .permute import ranked
from .windows import dedupe_keep

KEY = ["model", "stage", "grain", "feature_set", "split"]


def _scores(n: Column, sy: Column, syy: Column, see: Column, sae: Column) -> dict[str, Column]:
    sst = syy - sy * sy / n
    return {"rmse": F.sqrt(see / n), "mae": sae / n, "r2": F.when(sst > 1e-9 * F.greatest(syy, F.lit(1e-300)), 1 - see / sst)}


def evaluate(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """n, rmse, mae and r2 about the group's own mean; r2 is NULL for a constant target."""
    e = F.col("y_true") - F.col("y_pred")
    sums = df.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum("y_true").alias("_y"), F.sum(F.col("y_true") * F.col("y_true")).alias("_yy"), F.sum(e * e).alias("_ee"), F.sum(F.abs(e)).alias("_ae")
    )
    return sums.withColumns(_scores(*[F.col(c) for c in ("n", "_y", "_yy", "_ee", "_ae")])).drop("_y", "_yy", "_ee", "_ae")


def evaluate_per_entity(df: DataFrame, k: str, min_rows: int = 30) -> DataFrame:
    """Scores of each entity, r2 NULL below min_rows, with its place: NULLs first, then the worst."""
    out = evaluate(df, [k]).withColumn("r2", F.when(F.col("n") >= min_rows, F.col("r2")))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_first("r2"), k)))  # one row an entity


def entity_median_r2(per_entity: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return per_entity.groupBy(*group).agg(F.percentile("r2", 0.5).alias("median_r2"))


def stage_delta(results: DataFrame) -> DataFrame:
    """Tuned less default rmse and r2 for runs that have both."""
    value = lambda c, s: F.max(F.when(F.col("stage") == s, F.col(c)))
    wide = results.groupBy(*[c for c in KEY if c != "stage"]).agg(*[value(c, s).alias(f"_{c}_{s}") for c in ("rmse", "r2") for s in ("tuned", "default")])
    keys = [c for c in KEY if c != "stage"]
    return wide.dropna(subset=["_rmse_tuned", "_rmse_default"]).select(*keys, (F.col("_rmse_tuned") - F.col("_rmse_default")).alias("delta_rmse"), (F.col("_r2_tuned") - F.col("_r2_default")).alias("delta_r2"))


def error_breakdown(df: DataFrame, by: Sequence[str], k: str, model: str = "model") -> DataFrame:
    """(condition, level, model, rmse, mae, bias, n, entities, mean_y) for each of by; a condition with one level is left out."""
    levels = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("string").alias("level")) for c in by])).alias("_c")
    long = df.select("*", levels).select(*df.columns, "_c.condition", "_c.level").filter(F.col("level").isNotNull())
    e = F.col("y_pred") - F.col("y_true")
    out = long.groupBy("condition", "level", model).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.count("*").alias("n"), F.count_distinct(k).alias("entities"), F.avg("y_true").alias("mean_y"))
    many = out.groupBy("condition").agg(F.count_distinct("level").alias("_l")).filter("_l > 1").select("condition")
    return out.join(many, "condition", "left_semi")


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _block_sums(df: DataFrame, by: Sequence[str], more: dict[str, Column] | None = None) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y_true").alias("y"), F.sum(F.col("y_true") * F.col("y_true")).alias("yy"), F.sum(e * e).alias("ee"), F.sum(F.abs(e)).alias("ae"), *[c.alias(n) for n, c in (more or {}).items()])


def drawn_number(round_: int, place: int, seed: int) -> int:
    """A number below 2^60 from a hash of round, place and seed, which any engine with md5 can repeat."""
    return int(hashlib.md5(f"{round_}:{place}:{seed}".encode()).hexdigest()[:15], 16)


#: Blocks of a bucket at least, and buckets at most.
BUCKET, BUCKETS = 4096, 4096
#: Draws that a task makes at once, so that their arrays stay in its core's cache.
DRAWS = 65_536
_WORD = np.uint64(2**32 - 1)
#: The multipliers of MurmurHash3's 32-bit finaliser, and the golden ratio's 32 bits.
_MIX, _STEP = (0x85EBCA6B, 0xC2B2AE35), 0x9E3779B1


def mixed(x) -> np.ndarray:
    """A bijection of 32-bit numbers, held in 64 bits, whose bits all depend on all bits. Any engine with 64-bit integers can repeat it."""
    x = np.asarray(x, np.uint64) & _WORD
    for shift, by in zip((16, 13), _MIX, strict=True):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
        x &= _WORD
    x ^= x >> np.uint64(16)
    return x


def drawn_numbers(seed: int, stream: int, rounds, index, count) -> np.ndarray:
    """Numbers below count, each from its round and its index in it, by counters alone. stream tells draws apart."""
    rounds, index = np.asarray(rounds, np.uint64), np.asarray(index, np.uint64)
    key = mixed(rounds * np.uint64(_STEP) + np.uint64((seed * 8 + stream) & 0xFFFFFFFF))
    high, low = mixed(index + key), mixed(index * np.uint64(_STEP) + key)
    drawn, count = (high << np.uint64(31)) + (low >> np.uint64(1)), np.asarray(count, np.uint64)
    return drawn - drawn // count[()] * count  # NumPy divides by a scalar faster than it takes remainders


def block_rounds(df: DataFrame, block: Sequence[str], rounds: int = 1000, seed: int = 0, model: str | Sequence[str] = "model", bucket: int = BUCKET) -> DataFrame:
    """(round, model, rmse, mae, r2): in each round as many blocks are drawn with replacement as there are, the same ones for all models.

    Rows are read once, for the sums of each block and model; then blocks are numbered in key order, and runs of numbers are
    buckets, BUCKETS at most. A round first draws how many of its blocks come from each bucket, in tasks that share the draws;
    then each bucket draws so many of its own, in a task: together this is drawing from all blocks. Tasks return a
    number for each round and bucket, and a sum for each round and model. Draws come from counters (drawn_numbers), so that
    SQL repeats them and partitions don't matter. Without rows there are no rounds."""
    names = _names(model)
    return _rounds_of_sums(saved(_block_sums(df, [*block, *names]), "blocks"), list(block), rounds, seed, names, bucket)


def _rounds_of_sums(sums: DataFrame, block: list[str], rounds: int, seed: int, names: list[str], bucket: int = BUCKET) -> DataFrame:
    """block_rounds of saved sums of blocks."""
    spark = sums.sparkSession
    ship_code(spark)
    parts = ["n", "y", "yy", "ee", "ae"]
    numbers, n = ranked(sums.select(*block).distinct(), block, "_number")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*names).schema)
    size = max(bucket, -(-n // BUCKETS))
    count = -(-n // size) if n else 0
    numbers = numbers.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(block)], "_number")
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(block)]
    keyed = sums.join(numbers, same).withColumn("_bucket", F.expr(f"_number DIV {size}")).select("_bucket", "_number", *names, *[F.col(c).cast("double").alias(c) for c in parts])

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((rounds, count), np.int64)
        every = np.arange(1, rounds + 1)[:, None]
        for pdf in batches:
            for start in pdf["id"]:
                place = np.arange(start * BUCKET, min(n, (start + 1) * BUCKET))
                for lo in range(0, rounds, DRAWS // BUCKET):
                    found = drawn_numbers(seed, 0, every[lo : lo + DRAWS // BUCKET], place, n) // np.uint64(size)
                    at = np.arange(len(found), dtype=np.int64)[:, None] * count + found.astype(np.int64)
                    held[lo : lo + len(found)] += np.bincount(at.ravel(), minlength=len(found) * count).reshape(-1, count)
        if held.any():
            yield pd.DataFrame({"_bucket": np.arange(count), "held": [h.tobytes() for h in held.T]})

    def draw(key: tuple, own: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        b, take = int(key[0]), sum(np.frombuffer(h, np.int64) for h in shares["held"])
        width = min(size, n - b * size)
        found = [(k if isinstance(k, tuple) else (k,), own["_number"].to_numpy()[at] - b * size, own[parts].to_numpy(float, na_value=0.0)[at]) for k, at in own.groupby(names, dropna=False).indices.items()]
        tables = np.zeros((len(found), width, len(parts)))
        for i, (_, at, values) in enumerate(found):
            tables[i, at] = values
        out = np.zeros((len(found), rounds, len(parts)))
        step = max(1, DRAWS // width)
        for lo in range(0, rounds, step):
            n_own = take[lo : lo + step]
            row = np.repeat(np.arange(len(n_own)), n_own)
            index = np.arange(len(row)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
            picked = drawn_numbers(seed, 1, row + lo + 1, index + b * (1 << 20), width).astype(np.int64)
            times = np.bincount(row * width + picked, minlength=len(n_own) * width).reshape(-1, width).astype(float)
            out[:, lo : lo + step] = times @ tables
        made = [pd.DataFrame(x, columns=parts).assign(round=np.arange(1, rounds + 1), **dict(zip(names, k, strict=True))) for (k, *_), x in zip(found, out, strict=True)]
        return pd.concat(made)[["round", *names, *parts]]

    chunks = spark.range(-(-n // BUCKET)).repartition(max(1, min(-(-n // BUCKET), 4 * spark.sparkContext.defaultParallelism)))
    shares = chunks.mapInPandas(share, "_bucket long, held binary")
    met = keyed.groupBy("_bucket").cogroup(shares.groupBy("_bucket")).applyInPandas(draw, f"round long, {keys}, " + ", ".join(f"{c} double" for c in parts))
    met = met.groupBy("round", *names).agg(*[F.sum(c).alias(f"_{c}") for c in parts])
    return met.withColumns(_scores(*[F.col(f"_{c}") for c in parts])).drop(*[f"_{c}" for c in parts])


def block_bootstrap(df: DataFrame, block: Sequence[str], rounds: int = 1000, seed: int = 0, model: str | Sequence[str] = "model") -> DataFrame:
    """2.5 and 97.5 per cent points of r2, rmse and mae of each model over resampled blocks."""
    return intervals(block_rounds(df, block, rounds, seed, model), model)


def intervals(rounds: DataFrame, model: str | Sequence[str] = "model") -> DataFrame:
    ends = {f"{c}_{n}": F.percentile(c, q) for c in ("r2", "rmse", "mae") for n, q in (("low", 0.025), ("high", 0.975))}
    return rounds.groupBy(*_names(model)).agg(*[c.alias(n) for n, c in ends.items()])


def compare_to_best(rounds: DataFrame, scores: DataFrame, baselines: Sequence[str], model: str = "model", group: str | None = None) -> DataFrame:
    """Interval of each model's r2 less that of the best model that is no baseline, in the same rounds: better, worse,
    or not distinguishable. scores: (model, r2) of the whole.

    With group, a column of both tables, each value has its own best, and baselines that a group lacks are those of
    the first group with them. A round's models, a handful, lie in one array."""
    g = group or "_g"
    if group is None:
        rounds, scores = rounds.withColumn(g, F.lit(0)), scores.withColumn(g, F.lit(0))
    best = scores.filter(~F.col(model).isin(*baselines)).groupBy(g).agg(F.max_by(model, F.struct("r2", model)).alias("best"))
    rows = rounds.groupBy("round").agg(F.collect_list(F.struct(g, model, "r2")).alias("_all")).join(F.broadcast(best))

    def taken(e):
        rival = lambda o: (o[model] == e[model]) & ((o[g] == F.col(g)) | (o[g] < e[g]))
        return (e[g] == F.col(g)) | (e[model].isin(*baselines) & ~F.exists("_all", rival))

    top = F.filter("_all", lambda e: (e[g] == F.col(g)) & (e[model] == F.col("best")))
    rows = rows.select(g, "best", F.get(top, F.lit(0))["r2"].alias("_best_r2"), F.explode(F.filter("_all", taken)).alias("_e"))
    pairs = rows.select(g, "best", F.col(f"_e.{model}").alias(model), (F.col("_e.r2") - F.col("_best_r2")).alias("d"))
    out = pairs.groupBy(g, model, "best").agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high")).drop("_g")
    verdict = F.when(F.col(model) == F.col("best"), "best").when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("not distinguishable")
    return out.withColumn("verdict", verdict)


def compare_over_blocks(df: DataFrame, block: Sequence[str], baselines: Sequence[str], rounds: int = 1000, seed: int = 0, model: str = "model", group: str | None = None) -> DataFrame:
    """compare_to_best over block_rounds of df, with the scores that evaluate gives of the whole. Rows are read once: rounds and
    scores are both made from the sums of blocks."""
    names = [*([group] if group else []), model]
    y, whole = F.col("y_true"), F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    more = {"_n": F.count_if(whole), "_y": F.sum(F.when(whole, y)), "_yy": F.sum(F.when(whole, y * y))}
    sums = saved(_block_sums(df, [*block, *names], more), "blocks")
    total = sums.groupBy(*names).agg(*[F.sum(c).alias(c) for c in (*more, "ee", "ae")]).filter("_n > 0")
    scores = total.withColumns(_scores(*[F.col(c) for c in (*more, "ee", "ae")])).select(*names, "r2")
    return compare_to_best(_rounds_of_sums(sums, list(block), rounds, seed, names), scores, baselines, model, group)


def upsert_results(store: DataFrame, rows: DataFrame, order: str, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """The later of equal keys, by order; rows of the second table come later."""
    both = store.withColumn("_from", F.lit(0)).unionByName(rows.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return dedupe_keep(both, keys, ["_from", order], "last").drop("_from")


def best_run_per_grain(results: DataFrame, baselines: Sequence[str]) -> DataFrame:
    """Of each grain the run with the best validation r2 that is no baseline, with its test scores."""
    runs = ["model", "stage", "feature_set"]
    good = results.filter((F.col("split") == "validation") & ~F.col("model").isin(*baselines))
    best = good.groupBy("grain").agg(F.max_by(F.struct(*runs), F.struct("r2", *runs)).alias("_b"), F.max("r2").alias("validation_r2")).select("grain", "_b.*", "validation_r2")
    test = results.filter(F.col("split") == "test").select("grain", *runs, F.col("r2").alias("test_r2"), F.col("rmse").alias("test_rmse"))
    return best.join(test, ["grain", *runs], "left")


def timing_table(results: DataFrame, tuning: DataFrame) -> DataFrame:
    """Seconds of training by stage of each model, feature set and grain, with its tuning minutes; either may be absent."""
    keys = ["grain", "model", "feature_set"]
    wide = results.groupBy(*keys).agg(*[F.max(F.when(F.col("stage") == s, F.col("train_seconds"))).alias(f"seconds_{s}") for s in ("default", "tuned")])
    return wide.join(tuning, keys, "full")


def generalisation_gap(wide: DataFrame, rel: float = 0.25, r2: float = 0.15) -> DataFrame:
    """Gaps from train to validation (columns rmse_train, rmse_validation, r2_train, r2_validation) and the risk."""
    out = wide.withColumns({"rmse_gap": F.col("rmse_validation") - F.col("rmse_train"), "r2_gap": F.col("r2_train") - F.col("r2_validation")})
    out = out.withColumn("relative_gap", F.when(F.col("rmse_train") > 0, F.col("rmse_gap") / F.col("rmse_train")))
    a, b = F.coalesce(F.col("relative_gap") > rel, F.lit(False)), F.coalesce(F.col("r2_gap") > r2, F.lit(False))
    return out.withColumn("risk", F.when(a & b, "high").when(a | b, "moderate").otherwise("low"))
