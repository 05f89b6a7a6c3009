"""Hand-made frames: gaps, NULLs, ties, single groups, constants, empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalars
from panelspark.functions.distributions import t_tail
from panelspark.grain import daily, hour_ending_time, nan_to_null
from panelspark.operators import baselines, evaluate, events, explain, features, gram, joins, models, quality, reshape, stats, windows
from panelspark.sources import tables


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_gaps_in_time_are_not_bridged(spark):
    df = spark.createDataFrame([(1, d, v) for d, v in ((1, 1.0), (2, 2.0), (8, 3.0), (9, 4.0))], "k int, tick long, y double")
    lag, has = windows.exact_lag("k", "tick", "y", 1)
    out = df.withColumns({"lag": lag, "has": has})
    assert column(out, "lag", "tick") == [0.0, 1.0, 0.0, 3.0] and column(out, "has", "tick") == [0, 1, 0, 1]
    total, enough = windows.time_rolling("k", "tick", "y", 7, "sum", 1)
    out = df.withColumns({"s": total, "e": enough})
    assert column(out, "s", "tick") == [0.0, 1.0, 3.0, 5.0] and column(out, "e", "tick") == [0, 1, 1, 1]


def test_prior_statistics_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, 3.0), (1, 4, 5.0)], "k int, tick long, y double")
    out = df.withColumns(windows.prior_expanding("k", "tick", "y"))
    assert column(out, "prior_mean", "tick") == [None, 1.0, 1.0, 2.0]
    assert column(out, "prior_std", "tick") == [None, None, None, 1.0]


def test_pivot_null_group_is_zero_and_absent_is_null(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, "a", 3.0)], "i int, c string, v double")
    rows = reshape.pivot_classes(df, ["i"], "c", "v", {"a": "a", "b": "b"}).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, 0.0, 2.0), (2, 3.0, None)]
    rows = reshape.pivot_classes(df, ["i"], "c", "v", {"a": "a", "b": "b"}, missing_as_zero=False).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, None, 2.0), (2, 3.0, None)]


def test_bins_have_quantile_sizes(spark):
    df = spark.range(1112).withColumn("bin", windows.equal_bins(["id"], 5))
    assert [r["count"] for r in df.groupBy("bin").count().orderBy("bin").collect()] == [223, 222, 222, 222, 223]
    assert spark.range(1).withColumn("bin", windows.equal_bins(["id"], 5)).first()["bin"] == 1


def test_cutoffs_are_floored_to_days(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, d),) for d in (1, 2, 5)], "t timestamp")
    assert features.split_cutoffs(df, "t").first()["cut_validation"] == datetime.date(2024, 1, 3)


def test_hour_24_is_next_midnight(spark):
    df = spark.createDataFrame([(datetime.date(2023, 12, 31), 24)], "d date, h int")
    assert df.select(hour_ending_time("d", "h").alias("t")).first()["t"] == datetime.datetime(2024, 1, 1)
    assert df.select(daily("h", "d").tick().alias("t")).first()["t"] == 19722


def test_equally_near_events_choose_the_earlier(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 5),)], "d date")
    dates = spark.createDataFrame([(datetime.date(2024, 1, 4),), (datetime.date(2024, 1, 6),)], "event_date date")
    assert joins.nearest_event_window(df, "d", dates, 3).first()["event_date"] == datetime.date(2024, 1, 4)
    assert joins.nearest_event_window(df, "d", dates, 0).count() == 0


def test_single_direction_and_zero_volume(spark):
    df = spark.createDataFrame([(1, "E", 5.0), (2, "E", 0.0), (2, "W", 0.0)], "k int, c string, v double")
    one, two = stats.directional_summary(df, ["k"], "c", "v", ["E", "W"]).orderBy("k").collect()
    assert (one["imbalance"], one["dominant_share"], one["is_bidirectional"]) == (0.0, 1.0, 0)
    assert (two["share_E"], two["dominant_share"], two["is_bidirectional"]) == (0.0, 0.0, 1)


def test_constant_targets_and_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y_true double, y_pred double")
    assert evaluate.evaluate(df).first()["r2"] is None
    rows = spark.createDataFrame([("train", 4.0), ("train", 4.0)], "split string, x double")
    assert features.standardise(rows, features.scaler(rows, ["x"]), ["x"]).first()["x"] == 0.0
    assert "x" not in features.drop_constant(rows, ["x"]).columns and "x" in features.drop_constant(rows, ["x"], ["x"]).columns


def test_ridge_agrees_with_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = spark.range(400).select(((F.col("id") * 37 % 101) / 10).alias("a"), ((F.col("id") * 53 % 97) / 7).alias("b"), (F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.5)).alias("w"), F.col("id"))
    df = df.withColumn("y", 3 * F.col("a") - F.col("b") + (F.col("id") * 71 % 89) / 5).cache()
    model = gram.ridge_fit(df, ["a", "b"], "y", 100.0, "w")
    total = df.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy")).first()
    sd = (total["wyy"] / total["w"] - (total["wy"] / total["w"]) ** 2) ** 0.5
    fitted = LinearRegression(solver="normal", standardization=False, regParam=100.0 / total["w"] * sd, weightCol="w", labelCol="y", featuresCol="v").fit(VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df))
    assert list(model.beta[1:]) == pytest.approx(list(fitted.coefficients), rel=1e-4)
    assert model.beta[0] == pytest.approx(fitted.intercept, rel=1e-4)


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, x double")
    with pytest.raises(ValueError, match="repeated_key"):
        joins.dimension_join_checked(df, df, "k")
    with pytest.raises(ValueError, match="unmatched"):
        joins.dimension_join_checked(df, spark.createDataFrame([(2, "a")], "k int, n string"), "k")
    with pytest.raises(ValueError, match="missing"):
        quality.check_source(df, "y", ["x"], "x", ["x"])
    quality.require(quality.check_unique(df.limit(1), ["k"]))


def test_scalars_with_nulls(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (4.0, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(scalars.safe_divide(F.col("n"), F.col("d"), 7.0)).collect()] == [7.0, None, 2.0]
    texts = spark.createDataFrame([("  A--b ",), ("!!",), (None,)], "t string")
    assert [r[0] for r in texts.select(scalars.slug(F.col("t"))).collect()] == ["a_b", "unknown", "unknown"]
    marks = scalars.one_hot(spark.createDataFrame([(None,), ("a",)], "c string"), "c", "c", ["a", "Unknown"], null_as="Unknown")
    assert [tuple(r)[1:] for r in marks.collect()] == [(0, 1), (1, 0)]
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first()["x"] is None


def test_sequence_windows_mark_missing_steps(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 3, 30.0)], "k int, tick long, x double")
    rows = reshape.sequence_windows(df, "k", "tick", ["x"], 1, 3).orderBy("tick").collect()
    assert [(s["avail"], s["x"][0]) for s in rows[1]["sequence"]] == [(1.0, 10.0), (0.0, 0.0), (1.0, 30.0)]


def test_seeded_results_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "row").withColumn("x", F.col("row") * 1.0)
    one, many = (sorted(r["row"] for r in windows.sample_rows(df.repartition(n), "row", 50, 3).collect()) for n in (1, 7))
    assert one == many
    a, b = (sorted(map(tuple, explain.shuffled(df.repartition(n), "row", ["x"], 3).collect())) for n in (1, 7))
    assert a == b and sorted(x for _, x in a) == sorted(float(i) for i in range(500))


def test_shapley_adds_up(spark):
    df = spark.range(20).select(F.col("id").alias("row"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))

    class Product:
        def transform(self, rows, name):
            return rows.withColumn(name, F.col("a") * F.col("b"))

    total = {r["row"]: r["s"] for r in explain.family_shapley(df, Product(), {"a": ["a"], "b": ["b"]}, "row").groupBy("row").agg(F.sum("phi").alias("s")).collect()}
    mean = df.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    for r in df.collect():
        assert total[r["row"]] == pytest.approx(r["a"] * r["b"] - mean["a"] * mean["b"])


def test_trees_learn(spark):
    df = spark.range(300).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 * 2.0 + 1).alias("y"), (F.col("id") % 3 == 0).alias("v"))
    for fitted in (models.tree_fit(df, ["x"], "y"), models.gbt_fit(df, ["x"], "y", None, "v", rounds=20, step=0.5)):
        score = evaluate.evaluate(fitted.transform(df).withColumnRenamed("y", "y_true")).first()
        assert score["r2"] > 0.9
    best, table = models.search(df.withColumn("split", F.when(F.col("v"), "validation").otherwise("train")).unionByName(df.withColumn("split", F.lit("test"))), [{"depth": 1}, {"depth": 5}], lambda d, c: models.tree_fit(d, ["x"], "y", depth=c["depth"]), lambda d: evaluate.evaluate(d.withColumnRenamed("y", "y_true")).first()["rmse"])
    assert best == {"depth": 5} and table.filter("best").count() == 1
    assert len(models.candidates({"a": [1, 2], "b": [1, 2]}, [{"a": 1, "b": 1}], 10, 0)) == 4


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, tick long, y double, split string, row long")
    assert evaluate.evaluate(empty.withColumnRenamed("y", "y_true").withColumn("y_pred", F.lit(1.0)), ["k"]).count() == 0
    assert baselines.persistence_baseline(empty, "k", "tick", "y", 1).count() == 0
    assert windows.dedupe_keep(empty, ["k"], ["tick"]).count() == 0
    assert events.event_by_entity(empty.withColumn("flag", F.lit(1)), "k", "flag", ["y"]).count() == 0
    assert quality.check_unique(empty, ["k"]).first()["violations"] == 0


def test_t_tail():
    assert t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert t_tail(0.0, 5) == pytest.approx(1.0)


def test_stack_tables_keeps_labels(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "own")], "y int, label string")
    out = tables.stack_tables([a, b], [{"label": "a"}, {"label": "b"}])
    assert sorted(map(tuple, out.select("label", "x", "y").collect()), key=str) == [("a", 1, None), ("own", None, 2)]
