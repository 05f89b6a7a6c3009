"""Rolling features over sorted batches, against plain frames: whatever the batches, keys, gaps and values are."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import windows


def plain(df, specs):
    return df.withColumns({n: v for name, spec in specs.items() for n, v in zip((name, f"{name}_available"), windows.time_rolling("k", "tick", spec[0], *spec[1:]), strict=True)})


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_batches_equal_plain_frames(spark, size):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in (("a", 200), ("b", 1), (None, 40), ("c", 64), ("d", 33)):
        t = np.cumsum(rng.integers(0, 4, n)) - 50  # some ticks twice
        for i in range(n):
            y = None if rng.random() < 0.1 else float(rng.normal() + 1e6 * (k == "c"))
            rows.append((k, int(t[i]), y, float("nan") if k == "a" and i == 60 else float("inf") if k == "a" and i in (100, 102) else float(i % 5), i))
    rows += [("a", None, 1.0, 1.0, 900), ("a", None, 2.0, 1.0, 901), ("e", None, 1.0, 1.0, 902)]
    df = spark.createDataFrame(rows, "k string, tick long, y double, z double, row int")
    specs = {f"{c}_{agg}{w}": (c, w, agg, least) for c in "yz" for agg in ("mean", "std", "sum") for w, least in ((1, 1), (5, 2), (500, 3))}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = windows.rolling_features(df, "k", "tick", specs)
        assert found.columns == plain(df, specs).columns
        got = found.orderBy("k", "tick", "row").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = plain(df, specs).orderBy("k", "tick", "row").toPandas()
    assert len(got) == len(want) == len(rows)
    timed = want["tick"].notna()
    for c in want.columns[5:]:
        if c.startswith("z_std"):
            fit = timed & np.isfinite(want[c])  # of one infinite value Spark's deviation is NaN, as here
            assert (np.isfinite(got[c]) == np.isfinite(want[c]))[timed].all(), c
        else:
            fit = timed
        assert np.allclose(got[c][fit], want[c][fit], rtol=1e-9, atol=1e-5, equal_nan=True), c
        assert (got[c][~timed] == 0).all(), c
    assert windows.rolling_features(df.limit(0), "k", "tick", specs).count() == 0


def test_specs_are_no_window_functions(spark):
    """The time of an aggregate a spec and row is what made feature builds slow."""
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("tick"), F.lit(1.0).alias("y"))
    found = windows.rolling_features(df, "k", "tick", {f"m{w}": ("y", w, "mean", 1) for w in (2, 3, 5)})
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("k = 0 AND tick = 9").first().asDict() == {"k": 0, "tick": 9, "y": 1.0, "m2": 0.0, "m2_available": 0, "m3": 1.0, "m3_available": 1, "m5": 1.0, "m5_available": 1}


def test_many_entities_side_by_side():
    rng = np.random.default_rng(6)
    size = rng.integers(1, 40, 500)
    x = np.concatenate([rng.normal(size=n) * 10.0 ** rng.integers(-9, 9) for n in size])
    first = np.cumsum(size) - size
    want = np.concatenate([pd.Series(x[a : a + n]).cumsum().shift(1).fillna(0) for a, n in zip(first, size, strict=True)])
    assert windows._before(x[None, :], first, size)[0] == pytest.approx(want, rel=1e-9, abs=1e-20)
