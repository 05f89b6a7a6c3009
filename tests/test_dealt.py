"""Steps whose tasks must not grow with the tables: how often inputs are made, and how rows are dealt."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import shipping
from panelspark.operators import explain, joins, ranks, stats, windows


def _counted(spark, n=200):
    """Rows, and a counter of how many rows were made."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(x=pdf["id"] * 7 % 31 * 1.0, y=pdf["id"] * 11 % 101 * 1.0, k=pdf["id"] % 4)

    return spark.range(n).mapInPandas(rows, "id long, x double, y double, k long"), made


@pytest.mark.parametrize("step", ["percentiles", "cases", "bins", "outliers", "boxplot", "borrow"])
def test_input_is_made_once(spark, step):
    df, made = _counted(spark)
    if step == "percentiles":
        found, i = ranks.percentiles(df, {"x": [0.5], "y": [0.25]}), np.arange(200)
        assert found == {"x": [pytest.approx(np.quantile(i * 7 % 31, 0.5))], "y": [pytest.approx(np.quantile(i * 11 % 101, 0.25))]}
    elif step == "cases":
        assert windows.pick_cases(df, "id", "y", "x", F.col("k") == 1).count() == 4
    elif step == "bins":
        assert sum(r["n"] for r in explain.effect_by_bins(df.withColumns({"effect": F.col("x"), "s": F.lit(1)}), "id", "x", "y", "s").collect()) == 200
    elif step == "outliers":
        assert stats.iqr_outliers(df, "k", "y").count() == 4
    elif step == "boxplot":
        assert stats.boxplot_stats(df, "k", "y").count() == 4
    else:
        donors = spark.createDataFrame([(1, 2)], "k long, donor long")
        found = joins.borrow_column(df.withColumn("x", F.when(F.col("k") != 1, F.col("x"))).withColumn("d", F.floor(F.col("id") / 4)), donors, "x", "k", ["d"])
        assert found.filter("k = 1 AND x IS NOT NULL AND x_source = 2").count() == 50
    assert made.value == 200


def test_percentiles_of_small_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 50)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.repeat([1, 2, 3, 4], [1, 50, 51, 900]), "v": np.round(rng.normal(size=1002), 1)})
    found = {r["g"]: r for r in ranks.group_percentiles(spark.createDataFrame(pdf), "g", "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    for g, own in pdf.groupby("g")["v"]:
        assert found[g]["n"] == len(own) and found[g]["q"] == pytest.approx(list(np.quantile(own, [0, 0.25, 0.5, 1])))


def test_rows_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(shipping, "ROWS", 100)
    df = spark.range(3000).withColumn("k", F.col("id") % 100)
    assert shipping.dealt(df, "k").rdd.getNumPartitions() == 30 and shipping.dealt(df.limit(5)).rdd.getNumPartitions() == 8
    assert ranks.group_percentiles(df, "k", "id", [0.5]).rdd.getNumPartitions() == 30


def test_families_share_one_join_and_trees_one_table(spark, monkeypatch):
    from panelspark.operators import models
    from panelspark.operators.gram import left_out_predictions, ridge_fit

    df, made = _counted(spark)
    rows = df.withColumn("z", F.col("y") % 7)
    found = explain.permutation_importance(rows, ridge_fit(rows, ["x", "z"], "y", 1.0), {"a": ["x"], "b": ["x", "z"], "c": ["z"]}, "id", "y", 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 2  # places once and families once: one join for all
    monkeypatch.setattr(shipping, "ROWS", 10)
    parts = []
    fit = models.DecisionTreeRegressor.fit
    monkeypatch.setattr(models.DecisionTreeRegressor, "fit", lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    before = made.value
    models.tree_fit(df, ["x"], "y")
    assert parts == [20] and made.value - before == 200
    before = made.value
    left_out_predictions(df, ["x"], "y", 1.0, "k").count()
    assert made.value - before == 200


def test_comparisons_read_rows_once(spark):
    from panelspark.operators import evaluate

    df, made = _counted(spark)
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col("x") * f).alias("y_pred")) for m, f in (("B", 0.0), ("M", 3.0), ("N", 2.0))])).alias("p"), "*")
    rows = rows.select("id", "k", "p.*", F.when(F.col("id") != 7, F.col("y")).alias("y_true"))
    before = evaluate.compare_to_best(evaluate.block_rounds(rows, ["id"], 20, 1), evaluate.evaluate(rows, ["model"]).select("model", "r2"), ["B"])
    want = {r["model"]: r.asDict() for r in before.collect()}
    start = made.value
    found = {r["model"]: r.asDict() for r in evaluate.compare_over_blocks(rows, ["id"], ["B"], 20, 1).collect()}
    assert made.value - start == 200 and found == want and len(found) == 3
