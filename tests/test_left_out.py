"""Ablations and left-out groups against plain refits."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import gram, models, stats


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 6))
    x[:, 4] = x[:, 0] * x[:, 2]
    y = x @ np.array([2.0, -1.0, 0.5, 0.0, 1.0, 0.3]) + rng.normal(size=1200)
    rows = [(f"k{i % 13}", ("train", "validation", "test")[(i // 13) % 3], *map(float, x[i]), float(1 + i % 2), float(y[i])) for i in range(1200)]
    return spark.createDataFrame(rows, "k string, split string, a double, b double, c double, d double, ac double, e double, w double, y double")


def refit(table, columns, alpha, weight):
    train = table[table["split"] == "train"]
    w = train["w"].to_numpy() if weight else np.ones(len(train))
    x, y = train[columns].to_numpy(), train["y"].to_numpy()
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    beta = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + alpha * np.eye(len(columns)), (x - mx).T @ (w * (y - my)))
    out = []
    for s in ("validation", "test"):
        part = table[table["split"] == s]
        e = part["y"] - my - (part[columns].to_numpy() - mx) @ beta
        out += [np.sqrt((e**2).mean()), 1 - (e**2).sum() / ((part["y"] - part["y"].mean()) ** 2).sum()]
    return out


def test_every_variant_equals_a_refit(panel):
    families = {"drivers": ["a", "b"], "weather": ["c", "d"], "both": ["ac"]}
    unions = {"ALL drivers": ["drivers", "both"], "all": ["drivers", "weather", "both"]}
    more = {"unions": unions, "parts": {"b": ["b"]}, "excepting": {"but b": ("ALL drivers", "b")}}
    found = {r["variant"]: r for r in gram.ablation(panel, families, "y", 7.0, "w", added=["e", "a"], **more).collect()}
    own = ["a", "b", "c", "d", "ac"]
    want = {"full": own, "minus drivers": ["c", "d", "ac"], "minus weather": ["a", "b", "ac"], "minus both": ["a", "b", "c", "d"], "minus ALL drivers": ["c", "d"], "minus but b": ["b", "c", "d"], "minus b": ["a", "c", "d", "ac"], "minus all": [], "no weights": own, "no pruning": [*own, "e"]}
    assert set(found) == set(want)
    table = panel.toPandas()
    full = refit(table, own, 7.0, True)
    for name, columns in want.items():
        r, scores = found[name], refit(table, columns, 7.0, name != "no weights")
        assert [r[c] for c in ("rmse_validation", "r2_validation", "rmse_test", "r2_test")] == pytest.approx(scores) and r["n_features"] == len(columns)
        assert [r[c] for c in ("change_validation", "change_r2_validation", "change_test", "change_r2_test")] == pytest.approx([a - b for a, b in zip(scores, full, strict=True)], abs=1e-9)
    # without a penalty the minimal-norm solution serves
    plain = {r["variant"]: r["rmse_test"] for r in gram.ablation(panel, {"drivers": ["a", "b"], "weather": ["c"]}, "y", 0.0).collect()}
    assert plain["minus weather"] == pytest.approx(refit(table, ["a", "b"], 1e-9, False)[2], rel=1e-6)
    # a union among the families doesn't double its columns
    twice = {r["variant"]: r["rmse_test"] for r in gram.ablation(panel, {**families, "again": ["a", "b", "ac"]}, "y", 7.0, "w").collect()}
    assert twice["full"] == pytest.approx(full[2])


def test_left_out_entities_equal_refits(panel):
    table = panel.toPandas()
    found = gram.left_out_predictions(panel, ["a", "c"], "y", 5.0, "k", 93, "w").toPandas()
    large = sorted(k for k, n in table["k"].value_counts().items() if n >= 93)
    assert sorted(found["entity"].unique()) == large and len(large) < 13
    r2 = {"ridge": {}, "network_mean": {}}
    for k in large:
        rest, own = table[table["k"] != k], table[table["k"] == k]
        w, x, y = rest["w"].to_numpy(), rest[["a", "c"]].to_numpy(), rest["y"].to_numpy()
        mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
        beta = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + 5 * np.eye(2), (x - mx).T @ (w * (y - my)))
        guess = {"ridge": my + (own[["a", "c"]].to_numpy() - mx) @ beta, "network_mean": np.full(len(own), my)}
        for m, p in guess.items():
            part = found[(found["entity"] == k) & (found["model"] == m)]
            assert np.allclose(np.sort(part["y_pred"]), np.sort(p)) and len(part) == len(own)
            r2[m][k] = 1 - ((own["y"] - p) ** 2).sum() / ((own["y"] - own["y"].mean()) ** 2).sum()
    summary = {r["model"]: r for r in gram.summarise_left_out(gram.left_out_predictions(panel, ["a", "c"], "y", 5.0, "k", 93, "w")).collect()}
    for m in r2:
        values, part = list(r2[m].values()), found[found["model"] == m]
        e = part["y_true"] - part["y_pred"]
        assert [summary[m][c] for c in ("mean_r2", "median_r2", "worst_r2", "best_r2")] == pytest.approx([np.mean(values), np.median(values), min(values), max(values)])
        assert [summary[m][c] for c in ("pooled_rmse", "pooled_mae", "pooled_r2")] == pytest.approx([np.sqrt((e**2).mean()), e.abs().mean(), 1 - (e**2).sum() / ((part["y_true"] - part["y_true"].mean()) ** 2).sum()])
    assert summary["network_mean"]["n_better"] is None and summary["ridge"]["n_better"] == sum(r2["ridge"][k] > r2["network_mean"][k] for k in large)
    assert gram.summarise_left_out(gram.left_out_predictions(panel.limit(0), ["a"], "y", 1.0, "k")).count() == 0


def test_fits_run_side_by_side_within_a_bound(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def job(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        n = spark.range(i).count()
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return n

    assert models.side_by_side(spark, [lambda i=i: job(i) for i in range(7)], 3) == list(range(7)) and 1 < most[0] <= 3
    assert models.side_by_side(spark, []) == []


def test_trees_left_out_and_ablated(panel):
    fit = lambda rows: models.tree_fit(rows, ["a", "c"], "y", depth=2)
    found = models.leave_one_out(panel.filter("k < 'k2'"), "k", {"tree": fit}, "y", 90)
    rows = found.toPandas()
    table = panel.filter("k < 'k2'").toPandas()
    assert set(rows["model"]) == {"tree", "network_mean"}
    for k in rows["entity"].unique():
        mean = table[table["k"] != k]["y"].mean()
        assert np.allclose(rows[(rows["entity"] == k) & (rows["model"] == "network_mean")]["y_pred"], mean)
    k = rows["entity"].iloc[0]
    alone = fit(panel.filter((F.col("k") < "k2") & (F.col("k") != k))).transform(panel.filter(F.col("k") == k)).toPandas()
    assert np.allclose(np.sort(alone["y_pred"]), np.sort(rows[(rows["entity"] == k) & (rows["model"] == "tree")]["y_pred"]))
    assert models.leave_one_out(panel.limit(0), "k", {"tree": fit}, "y").count() == 0
    scores = models.ablation(panel, {"a": ["a", "b"], "c": ["c"]}, lambda rows, columns: models.tree_fit(rows, columns, "y", depth=2), "y", parts={"b": ["b"]})
    found = {(r["variant"], r["split"]): (r["n_features"], r["change_rmse"]) for r in scores.collect()}
    assert len(found) == 8 and found["full", "test"] == (3, 0.0) and found["minus b", "test"][0] == 2 and found["minus a", "test"][1] > 0.2


def test_search_without_candidates_or_scores(panel):
    fit = lambda rows, c: gram.ridge_fit(rows, ["a"], "y", c["alpha"])
    best, table = models.search(panel, [], fit, lambda rows: 1.0)
    assert best == {} and table.count() == 0
    for none in (None, float("nan")):
        best, table = models.search(panel, [{"alpha": 1.0}], fit, lambda rows, none=none: none)
        assert best == {} and table.filter("best").count() == 0
    scores = iter([None, 3.0, 4.0])
    assert models.search(panel, [{"alpha": 1.0}, {"alpha": 2.0}], fit, lambda rows: next(scores))[0] == {"alpha": 2.0}


def test_groups_against_an_attribute(spark):
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", -0.2), ("d", None), ("e", float("nan")), ("f", 0.3)], "k string, r double")
    places = spark.createDataFrame([("a", 1.0, "OK"), ("b", 4.0, "OK"), ("c", 9.0, "REVIEW"), ("d", 2.0, "OK"), ("e", 2.0, "REVIEW"), ("f", None, "OK")], "k string, far double, flag string")
    (r,) = stats.corr_by_attribute(scores, places, "k", "r", "far").collect()
    slope, intercept = np.polyfit([1, 4, 9], [0.5, 0.1, -0.2], 1)
    assert tuple(r) == pytest.approx((3, np.corrcoef([1, 4, 9], [0.5, 0.1, -0.2])[0, 1], slope, intercept))
    found = {x["flag"]: x for x in stats.describe_by(scores.join(places, "k"), "flag", "r").collect()}
    assert (found["OK"]["n"], found["OK"]["median"], found["OK"]["largest"]) == (3, 0.3, 0.5) and found["OK"]["sd"] == pytest.approx(0.2) and found["REVIEW"]["sd"] is None
