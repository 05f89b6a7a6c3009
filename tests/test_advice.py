"""Whole jobs: what the queries named _all and their operators give beyond the subsets that have SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluate
from panelspark.plans import q_joins, q_models, registry, testbed

SF = "/root/testdata/sf0.01"


def test_bootstrap_takes_every_entity_and_round(spark):
    bed = testbed.Testbed(spark, SF)
    rows = q_models._all_blocks(bed)
    assert rows.filter("k >= 20").count() > 0
    found = {r["model"]: r for r in registry.QUERIES["O_E6_block_bootstrap_all"](spark, SF).collect()}
    # brute force: independent draws of the same blocks
    e = F.col("y_true") - F.col("y_pred")
    sums = {"n": F.count("y_true"), "y": F.sum("y_true"), "yy": F.sum(F.col("y_true") * F.col("y_true")), "ee": F.sum(e * e)}
    table = rows.groupBy("k", "wk").pivot("model").agg(*[x.alias(c) for c, x in sums.items()]).orderBy("k", "wk").toPandas()
    draws = np.random.default_rng(0).multinomial(len(table), np.full(len(table), 1 / len(table)), 2000)
    for m in found:
        n, y, yy, ee = (draws @ table[f"{m}_{c}"].to_numpy() for c in ("n", "y", "yy", "ee"))
        low, high = np.quantile(1 - ee / (yy - y * y / n), [0.025, 0.975])
        assert found[m]["r2_low"] == pytest.approx(low, abs=0.2 * (high - low)) and found[m]["r2_high"] == pytest.approx(high, abs=0.2 * (high - low))


def test_many_rounds_of_many_blocks(spark):
    rows = spark.range(20000).select("id", F.lit("m").alias("model"), F.col("id").cast("double").alias("y_true"), (F.col("id") + 1).cast("double").alias("y_pred"))
    assert evaluate.block_rounds(rows, ["id"], 200, 3).filter("rmse = 1").count() == 200


def test_monitor_table_has_every_row_and_several_files(spark, monkeypatch):
    made, merge = [], "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    monkeypatch.setattr(q_joins, "_folder", lambda t, name, f=q_joins._folder: made.append(f(t, name)) or made[-1])
    assert registry.QUERIES["O_S2_read_monitor_table_all"](spark, SF).count() == testbed.Testbed(spark, SF).hourly.count()
    registry.QUERIES["O_S2_read_monitor_table"](spark, SF)
    spark.conf.unset(merge)
    files = [spark.read.text(f"{path}/*").select(F.input_file_name()).distinct().count() for path in made]
    assert min(files) > 1


def test_shapley_values_of_every_row(spark):
    daily = testbed.Testbed(spark, SF).daily
    assert daily.count() > 1000
    found = registry.QUERIES["O_X2_family_shapley_all"](spark, SF)
    assert found.count() == 3 * daily.count() and found.select("row_id").distinct().count() == daily.count()


def test_best_of_each_feature_set_meets_the_baselines(spark):
    rounds = spark.createDataFrame([(r, f, m, v + r / 100) for r in (1, 2, 3) for f, m, v in (("all", "B1", 0.1), ("all", "M1", 0.5), ("all", "M2", 0.3), ("exo", "M2", 0.05))], "round long, feature_set string, model string, r2 double")
    scores = rounds.filter("round = 1").select("feature_set", "model", "r2")
    found = {(r["feature_set"], r["model"]): (r["best"], r["verdict"]) for r in evaluate.compare_to_best(rounds, scores, ["B1"], group="feature_set").collect()}
    assert found == {("all", "B1"): ("M1", "worse"), ("all", "M1"): ("M1", "best"), ("all", "M2"): ("M1", "worse"), ("exo", "M2"): ("M2", "best"), ("exo", "B1"): ("M2", "better")}
