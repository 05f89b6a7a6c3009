"""Places of rows and keyed permutations: bijections, spread, no bounds by bucket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import explain, permute, windows


def whole(n, seed):
    out = []
    for r in range(n):
        x = permute.step(r, n, seed)
        steps = 0
        while x >= n:
            x, steps = permute.step(x, n, seed), steps + 1
        out.append((x, steps))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 100, 101, 1000, 4097])
def test_each_place_is_hit_once(n):
    for seed in (0, 1, 12):
        found = whole(n, seed)
        assert sorted(x for x, _ in found) == list(range(n))
        assert max(s for _, s in found) <= permute.steps_beyond(n, seed)


def test_columns_equal_the_numbers(spark):
    for n, seed in ((1, 0), (101, 3), (997, 9)):
        found = [r["p"] for r in spark.range(n).select(permute.permuted(F.col("id"), n, seed).alias("p"), "id").orderBy("id").collect()]
        assert found == [x for x, _ in whole(n, seed)]


def test_ranks_of_any_key(spark):
    rows = [(f"k{i:04d}", i * 1.5) for i in range(1000)]
    for parts in (1, 7):
        table, n = permute.ranked(spark.createDataFrame(rows, "key string, x double").repartition(parts), ["key"])
        assert n == 1000 and [r["rank"] for r in table.orderBy("key").collect()] == list(range(1000))
    empty, n = permute.ranked(spark.createDataFrame([], "key string"), ["key"])
    assert n == 0 and empty.count() == 0


def test_exchanges_are_whole_and_spread(spark):
    """Other repeats aren't rotations, rows leave any bucket of neighbours, and gaps are as spread as chance."""
    n = 4096
    df = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("x"))
    found = [np.array([r["x"] for r in explain.shuffled(df, "row", ["x"], seed).orderBy("row").collect()]) for seed in (0, 1)]
    for x in found:
        assert sorted(x) == list(range(n)) and len(np.unique(np.diff(x))) > n // 2
        assert abs(np.mean(np.abs(x - np.arange(n))) - n / 3) < 0.05 * n  # of two places drawn by chance
        assert np.mean(x % 64 == np.arange(n) % 64) < 0.05 and len(np.unique(x[::64] // 64)) > 30
    first, second = found
    place = np.argsort(first)
    assert len(np.unique((np.argsort(second) - place) % n)) > n // 2  # rotations have one
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.06 and abs(np.corrcoef(first, np.arange(n))[0, 1]) < 0.06


def test_samples_are_spread_and_take_any_key(spark):
    ids = [r["id"] for r in windows.sample_rows(spark.range(32_000), "id", 500, 5).orderBy("id").collect()]
    gaps = np.diff(ids)
    assert len(ids) == 500 and len(np.unique(gaps)) > 60 and np.mean(gaps == 1) < 0.05
    assert abs(gaps.std() / gaps.mean() - 1) < 0.2  # geometric, as of chance
    far = spark.range(100).select((F.col("id") * 2_000_000_000_000_000).alias("id"))
    assert windows.sample_rows(far, "id", 10, 1).count() == 10
    words = spark.createDataFrame([(f"w{i}",) for i in range(50)], "w string")
    assert windows.sample_rows(words, "w", 80, 1).count() == 50


def test_importance_of_repeats_varies(spark):
    from panelspark.operators.gram import Linear

    rng = np.random.default_rng(0)
    rows = [(i, float(v), float(w), float(2 * v + w)) for i, (v, w) in enumerate(rng.normal(size=(500, 2)))]
    df = spark.createDataFrame(rows, "row long, a double, b double, y double")
    found = {r["family"]: (r["drop_mean"], r["drop_sd"]) for r in explain.permutation_importance(df, Linear(("a", "b"), (0.0, 2.0, 1.0)), {"a": ["a"], "b": ["b"]}, "row", "y", 8).collect()}
    assert found["a"][0] == pytest.approx(2 * 4 / 5, abs=0.15) and found["b"][0] == pytest.approx(2 * 1 / 5, abs=0.1) and found["a"][1] > 0.005
