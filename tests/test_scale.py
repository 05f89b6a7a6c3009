"""What must hold at any size: exact ranks without one window, code that reaches tasks, empty tables and splits."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import distributions
from panelspark.operators import evaluate, events, explain, features, gram, joins, models, ranks, reshape, stats, windows

ROOT = Path(__file__).resolve().parents[1]


def test_order_statistics_against_a_sort(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELLS", 8)
    rng = np.random.default_rng(1)
    a = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000))
    b = rng.integers(-3, 3, 3000).astype(float)
    rows = pd.DataFrame({"a": a, "b": b, "c": [None] * 2990 + list(range(10))})
    df = spark.createDataFrame(rows.astype({"c": "float64"}), "a double, b double, c double").repartition(5)
    wanted = {"a": [1, 2, 500, 1500, 2999, 3000], "b": [1, 700, 3000], "c": [1, 10]}
    found = ranks.order_statistics(df, wanted)
    for name, at in wanted.items():
        x = np.sort(rows[name].dropna().to_numpy(float))
        assert found[name] == [(x[r - 1], int((x < x[r - 1]).sum()), int((x == x[r - 1]).sum())) for r in at]
    qs = [0.0, 0.25, 1 / 3, 0.5, 0.975, 1.0]
    got = ranks.percentiles(df.withColumn("none", F.lit(None).cast("double")), {"a": qs, "b": qs, "c": qs, "none": [0.5]})
    assert got["none"] == [None]
    for name in "abc":
        assert got[name] == pytest.approx(list(np.quantile(rows[name].dropna().to_numpy(float), qs)))
    assert ranks.percentiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_bins_equal_those_of_a_window(spark):
    df = spark.range(777).select(F.col("id").alias("row"), (F.col("id") * 37 % 11).alias("x"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("y"))
    made = ranks.bins(df, {"x": 10, "y": 3}, "row")
    out = df.withColumns({"bx": made["x"], "by": made["y"], "wx": windows.equal_bins(["x", "row"], 10)})
    assert out.filter("bx <> wx").count() == 0
    known = out.filter("y IS NOT NULL").withColumn("wy", windows.equal_bins(["y", "row"], 3))
    assert known.filter("by <> wy").count() == 0 and out.filter("y IS NULL AND by IS NOT NULL").count() == 0
    assert df.limit(1).select(ranks.bins(df.limit(1), {"x": 10}, "row")["x"]).first()[0] == 1


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 60)) @ rng.normal(size=(60, 60)) + 1000
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 3.0
    x[:, 6] = np.nan
    names = [f"v{i}" for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    want = pd.DataFrame(x, columns=names).corr()
    rows = stats.corr_matrix(df, names).collect()
    assert len(rows) == 60 * 59 // 2
    for r in rows:
        w = want.loc[r["a"], r["b"]]
        assert r["r"] is None if {"v5", "v6"} & {r["a"], r["b"]} else r["r"] == pytest.approx(w, abs=1e-9)
    assert stats.corr_matrix(df, ["v0"]).count() == 0
    pruned = {r["feature"]: r["kept"] for r in features.prune_sets(df.withColumn("split", F.lit("train")), {"a": names[:6], "b": names[7:9]}).collect()}
    assert len(pruned) == 8 and pruned["v5"] == 0


def test_nearest_site_keeps_every_point(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 10.0, 10.0), (3, None, 1.0)], "id int, lat double, lon double")
    sites = spark.createDataFrame([("b", 0.0, 1.0), ("a", 0.0, -1.0), ("c", 11.0, 10.0), ("d", None, None)], "site string, lat double, lon double")
    rows = sorted((r["id"], r["site"], r["distance_km"]) for r in joins.nearest_site(points, sites).filter("id < 3").collect())
    assert rows == [(1, "a", 111.2), (1, "a", 111.2), (2, "c", 111.2)]
    assert joins.nearest_site(points, sites).filter("id = 3").first()["site"] is None
    none = joins.nearest_site(points.withColumn("assigned", F.lit("x")), sites.limit(0), "assigned").collect()
    assert len(none) == 4 and all(r["site"] is None and r["flag"] == "REVIEW" for r in none)


def test_draws_reach_every_block_evenly(spark):
    n, rounds = 40, 200
    for own in (np.array([evaluate.drawn_number(r, i, 3) % n for r in range(1, rounds + 1) for i in range(n)]), evaluate.drawn_numbers(3, 0, np.arange(1, rounds + 1)[:, None], np.arange(n), n).ravel().astype(int)):
        counts = np.bincount(own, minlength=n)
        assert ((counts - rounds) ** 2 / rounds).sum() < 80  # chi-squared with 39 degrees of freedom
    # numbers of one round, and of one place, don't go together
    found = evaluate.drawn_numbers(5, 1, np.arange(1, 400)[:, None], np.arange(400), 1 << 31).astype(float)
    assert abs(np.corrcoef(found[:-1].ravel(), found[1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(found[:, :-1].ravel(), found[:, 1:].ravel())[0, 1]) < 0.02
    assert abs(found.mean() / 2**31 - 0.5) < 0.01 and len(np.unique(evaluate.mixed(np.arange(100_000)))) == 100_000


def brute_rounds(table, width, rounds, seed, n):
    """Scores of each round of table (block number, model, y_true, y_pred), with the draws one by one."""
    out = {}
    for r in range(1, rounds + 1):
        first = [int(evaluate.drawn_numbers(seed, 0, r, i, n)) // width for i in range(n)]
        times = {}
        for b in sorted(set(first)):
            for j in range(first.count(b)):
                block = b * width + int(evaluate.drawn_numbers(seed, 1, r, j + b * (1 << 20), min(width, n - b * width)))
                times[block] = times.get(block, 0) + 1
        assert sum(times.values()) == n
        for m, own in table.groupby("model"):
            drawn = own.loc[own.index.repeat(own["number"].map(times).fillna(0).astype(int))]
            e = drawn["y_true"] - drawn["y_pred"]
            out[r, m] = (np.sqrt((e**2).mean()), e.abs().mean(), 1 - (e**2).sum() / ((drawn["y_true"] - drawn["y_true"].mean()) ** 2).sum())
    return out


def test_rounds_of_blocks_equal_rows_drawn_one_by_one(spark):
    rng = np.random.default_rng(6)
    rows = [(f"k{i % 9}" if i % 50 else None, int(i // 9 % 8), m, float(v), float(v + w)) for i, (v, w) in enumerate(rng.normal(size=(900, 2))) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "k string, w long, model string, y_true double, y_pred double")
    table = df.toPandas()
    order = {key: i for i, key in enumerate(sorted({(k or "", w) for k, w, *_ in rows}))}
    table["number"] = [order[k or "", w] for k, w in zip(table["k"], table["w"], strict=True)]
    want = brute_rounds(table, 16, 25, 4, len(order))
    for parts in (1, 5):
        found = evaluate.block_rounds(df.repartition(parts), ["k", "w"], 25, 4, bucket=16).collect()
        assert len(found) == len(want)
        assert all((r["rmse"], r["mae"], r["r2"]) == pytest.approx(want[r["round"], r["model"]]) for r in found)
    assert evaluate.block_rounds(df.limit(0), ["k"], 5).count() == 0 and evaluate.block_bootstrap(df.limit(0), ["k"], 5).count() == 0
    one = evaluate.block_bootstrap(df, ["k"], 50).first()
    assert one["r2_low"] < one["r2_high"]


def test_permutations_exchange_each_row_once(spark):
    df = spark.range(1000).select(F.col("id").alias("row"), F.col("id").cast("double").alias("x"))
    for seed in (1, 64):
        assert sorted(r["x"] for r in explain.shuffled(df, "row", ["x"], seed).collect()) == [float(i) for i in range(1000)]


def test_interactions_of_a_product(spark):
    df = spark.range(30).select(F.col("id").alias("row"), *[(F.col("id") % m).cast("double").alias(c) for c, m in (("a", 5), ("b", 3), ("c", 7))])

    class Model:
        def transform(self, rows, name):
            return rows.withColumn(name, F.col("a") * F.col("b") * 2 + F.col("c"))

    pairs = explain.family_interactions(df, Model(), {c: [c] for c in "abc"}, "row")
    found = {(r["row"], r["family_a"], r["family_b"]): r["interaction"] for r in pairs.collect()}
    mean = df.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    for r in df.collect():
        assert found[r["row"], "a", "b"] == pytest.approx(2 * (r["a"] - mean["a"]) * (r["b"] - mean["b"]))
        assert found[r["row"], "a", "c"] == pytest.approx(0) == found[r["row"], "b", "c"]
    table = {(r["family_a"], r["family_b"]): r["share"] for r in explain.interaction_table(pairs).collect()}
    assert table["a", "b"] == pytest.approx(1)


def test_sequences_of_null_ticks_and_wide_steps(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0), (1, 4, 3.0), (1, 5, 9.0), (1, None, 7.0), (None, 2, 8.0)], "k int, tick int, x double")
    rows = {(r["k"], r["tick"]): [(s["avail"], s["x"][0]) for s in r["sequence"]] for r in reshape.sequence_windows(df, "k", "tick", ["x"], 2, 3).collect()}
    assert rows[1, 4] == [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)] and rows[1, 5] == [(0.0, 0.0), (0.0, 0.0), (1.0, 9.0)]
    assert rows[None, 2] == [(0.0, 0.0), (0.0, 0.0), (1.0, 8.0)] and rows[1, None] == [(0.0, 0.0)] * 3


def test_splits_without_rows(spark):
    rows = spark.range(60).select((F.col("id") % 4).alias("k"), F.col("id").alias("tick"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), F.lit("train").alias("split"), F.lit(1).alias("flag"))
    for df in (rows, rows.limit(0), rows.withColumn("split", F.lit("test"))):
        found = gram.search_alpha(df, ["x"], "y", [1.0, 2.0]).collect()
        assert len(found) == 2 and not any(r["best"] for r in found)
        assert gram.learning_curve(df, ["x"], "y", 1.0, "k", "tick").count() == 5
        assert gram.learning_curve_by_entity(df, ["x"], "y", 1.0, "k", "tick").count() == 0
        assert gram.ablation(df, {"a": ["x"]}, "y", 1.0).count() == 2
        assert gram.leave_one_entity_out(df, ["x"], "y", 1.0, "k", 10).count() == df.select("k").distinct().count()
        assert events.event_effect(df.withColumn("w", F.lit("a")), "flag", [], "y", "w", 5).count() == 1
        assert stats.train_median(df, "x").count() == 1 and features.impute_train_median(df, ["x"]).count() == df.count()
        assert features.prune_correlated(df, ["x", "y"]).count() == 2
        assert windows.pick_cases(df, "tick", "y", "x", F.col("flag") == 1).count() in (0, 4)
    empty = rows.limit(0)
    assert gram.ridge_fit(empty, ["x"], "y", 1.0).beta == (0.0, 0.0)
    assert events.event_effect(empty.withColumn("w", F.lit("a")), "flag", [], "y", "w", 5).first()["effect_pct"] is None
    assert stats.distribution_stats(empty, "y").first()["n"] == 0
    assert features.split_cutoffs(empty.withColumn("t", F.current_timestamp()), "t").first()["cut_test"] is None
    assert explain.permutation_importance(empty.withColumn("row", F.col("tick")), gram.Linear(("x",), (0.0, 1.0)), {"a": ["x"]}, "row", "y", 1).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        models.tree_fit(empty, ["x"], "y")


def test_code_reaches_tasks_from_any_folder(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession, functions as F
        from panelspark.operators import evaluate, gram, ranks, stats
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        df = spark.range(100).select((F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"), (F.col("id") % 2).alias("f"), F.lit("m").alias("model"))
        sys.path.pop(0)
        assert gram.ridge_fit(df, ["x"], "y", 1.0).beta[0] != 0
        assert stats.welch_t(df, "y", "f").first()["p"] > 0
        assert stats.corr_matrix(df, ["x", "y"]).count() == 1
        assert gram.leave_one_entity_out(df, ["x"], "y", 1.0, "f").count() == 2
        rows = df.withColumnsRenamed({{"y": "y_true", "x": "y_pred"}})
        assert evaluate.block_rounds(rows, ["f"], 3).count() == 3
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]


def test_tails_of_null(spark):
    df = spark.createDataFrame([(None, 3.0), (2.0, None)], "t double, f double")
    assert [r[0] for r in df.select(distributions.t_two_sided(F.col("t"), F.col("f"))).collect()] == [None, None]
