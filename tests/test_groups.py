"""Order statistics of many groups, and effects of events with entities absorbed, against plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import events, ranks, stats, windows
from panelspark.operators.evaluate import drawn_number

SF = "/root/testdata/sf0.001"


def test_percentiles_of_groups_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"one": [4.0], "two": [1.0, 2.0], "ties": [7.0] * 30_000 + [8.0] * 10_000, "large": rng.normal(size=60_000).tolist(), "steps": np.floor(rng.exponential(3, 20_000)).tolist(),
              "small": rng.normal(size=999).tolist(), "edge": list(range(5000)), "beyond": list(range(5001))}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("nan", float("nan")), (None, 1.0), ("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: (r["n"], r["q"]) for r in ranks.group_percentiles(df, "g", "v", wanted).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g][0] == len(values) and np.allclose(found[g][1], np.quantile(values, wanted), rtol=1e-12, atol=1e-12), g


def test_one_entity_is_counted_in_all_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 200_003).cast("double").alias("v"))
    plan = ranks.group_percentiles(df, "k", "v", [0.25, 0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    (row,) = stats.iqr_outliers(df, "k", "v").collect()
    assert (row["n"], row["n_outliers"]) == (200_000, 0) and row["q1"] == pytest.approx(np.quantile((np.arange(200_000) * 7919) % 200_003, 0.25))
    assert stats.iqr_outliers(df.withColumn("v", F.lit(None).cast("double")), "k", "v").first()["n"] == 0


def test_bins_of_all_rows(spark):
    df = windows.equal_bins_of_all(spark.range(1112).repartition(6), ["id"], 5)
    assert [r["count"] for r in df.groupBy("bin").count().orderBy("bin").collect()] == [223, 222, 222, 222, 223]
    assert windows.equal_bins_of_all(spark.range(1), ["id"], 5).first()["bin"] == 1 and windows.equal_bins_of_all(spark.range(0), ["id"], 5).count() == 0


def explicit(table, flag, covariates, dummies, y, times):
    """The flag's coefficient by least squares with a column for each level but the first."""
    rows = table.loc[table.index.repeat(times)]
    columns = [np.ones(len(rows)), rows[flag], *[rows[c] for c in covariates]]
    for d in dummies:
        columns += [(rows[d] == v).astype(float) for v in sorted(rows[d].unique())[1:]]
    return np.linalg.lstsq(np.column_stack(columns), rows[y].to_numpy(), rcond=None)[0][1]


def test_event_effect_equals_explicit_dummies(spark):
    from panelspark.plans import q_models, testbed

    near = q_models._near_events(testbed.Testbed(spark, SF))
    table = near.toPandas()
    names, rounds, seed = sorted(table["window"].unique()), 40, 2
    for y, logged in (("log_y", True), ("y", False)):
        (found,) = events.event_effect(near, "event", ["wind", "rain", "lacks"], y, "window", rounds, seed, logged, "k", ["month"]).collect()
        rest = (["wind", "rain", "lacks"], ["k", "month"], y)
        scaled = lambda c, y=y, logged=logged: 100 * (np.expm1(c) if logged else c / table[table["event"] == 0][y].mean())
        assert found["effect_pct"] == pytest.approx(scaled(explicit(table, "event", *rest, np.ones(len(table), int))), rel=1e-6)
        drawn = []
        for b in range(1, rounds + 1):
            times = np.bincount([drawn_number(b, i, seed) % len(names) for i in range(len(names))], minlength=len(names))
            drawn.append(scaled(explicit(table, "event", *rest, table["window"].map(dict(zip(names, times, strict=True))).to_numpy())))
        assert [found["low"], found["high"]] == pytest.approx(np.percentile(drawn, [2.5, 97.5]).tolist(), rel=1e-5)
        assert (found["windows"], found["n"], found["entities"]) == (len(names), len(table), table["k"].nunique())


def test_event_effect_of_odd_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(f"e{i % 9}", f"w{i % 5}", float(i % 11 == 0), float(v), int(i % 3), float(i % 9 + 2 * (i % 11 == 0) + 0.5 * (i % 3) + v)) for i, v in enumerate(rng.normal(size=900))]
    df = spark.createDataFrame(rows + [(None, "w1", 1.0, 1.0, 1, 1.0), ("e1", "w1", None, 1.0, 1, 1.0)], "k string, w string, flag double, x double, m int, y double")
    (found,) = events.event_effect(df, "flag", ["x"], "y", "w", 50, 1, False, "k", ["m"]).collect()
    control = np.mean([r[5] for r in rows if r[2] == 0])
    assert found["effect_pct"] == pytest.approx(200 / control) and found["n"] == 900 and found["entities"] == 9
    # a covariate that repeats another, and a flag that never varies inside entities
    same = events.event_effect(df.withColumn("x2", F.col("x") * 3), "flag", ["x", "x2"], "y", "w", 5, 1, False, "k", ["m"]).first()
    assert same["effect_pct"] == pytest.approx(found["effect_pct"])
    assert events.event_effect(df.withColumn("flag", (F.col("k") == "e1").cast("double")), "flag", ["x"], "y", "w", 5, 1, False, "k").first()["effect_pct"] is None
    with pytest.raises(ValueError):
        events.event_effect(df.withColumn("m", F.col("x")), "flag", [], "y", "w", 5, dummies=["m"])
