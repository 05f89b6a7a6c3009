"""Scans in slices, rolling sums as differences, sites in cells and events by day, against the plain forms."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import joins, reshape, scans, windows


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, n in (("a", 700), ("b", 40), ("c", 1), (None, 30)):
        ticks = np.sort(rng.choice(np.arange(-500, 5000), n, replace=False))
        rows += [(k, int(t), float(v) if rng.random() > 0.15 else None, int(t) % 3) for t, v in zip(ticks, rng.normal(50, 10, n), strict=True)]
    return spark.createDataFrame(rows, "k string, tick long, y double, slot int").repartition(6)


def frame(df, *order):
    return df.toPandas().sort_values(list(order), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("width", [1, 97, 100_000])
def test_slices_equal_whole_entities(panel, width):
    whole = frame(panel.withColumns(windows.prior_expanding("k", "tick", "y")), "k", "tick")
    found = frame(scans.prior_expanding_of_slices(panel, ["k"], "tick", "y", width), "k", "tick")
    assert list(found.columns) == list(whole.columns)
    for c in whole.columns[4:]:
        assert np.allclose(found[c].astype(float), whole[c].astype(float), rtol=1e-9, atol=1e-7, equal_nan=True), c
    fill, has = windows.forward_fill("k", "tick", "y")
    whole = frame(panel.withColumns({"f": fill, "f_available": has}), "k", "tick")
    pd.testing.assert_frame_equal(frame(scans.forward_fill_of_slices(panel, ["k"], "tick", "y", width, "f"), "k", "tick"), whole)
    surprise, has = windows.slot_surprise("k", ["slot"], "tick", "y")
    whole = frame(panel.withColumns({"surprise": surprise, "has_slot": has}), "k", "tick")
    found = frame(scans.slot_surprise_of_slices(panel, ["k", "slot"], "tick", "y", width), "k", "tick")
    assert np.allclose(found["surprise"], whole["surprise"], atol=1e-9) and (found["has_slot"] == whole["has_slot"]).all()


@pytest.mark.parametrize("width", [2, 50, 10_000])
def test_sequences_over_slices(panel, width):
    rows = panel.filter("k IS NOT NULL").fillna(0.0, ["y"])
    plain = {(r["k"], r["tick"]): r["sequence"] for r in reshape.sequence_windows(rows, "k", "tick", ["y"], 2, 5).collect()}
    found = scans.sequence_windows_of_slices(rows, ["k"], "tick", ["y"], 2, 5, width)
    assert found.columns == [*rows.columns, "sequence"]
    assert {(r["k"], r["tick"]): r["sequence"] for r in found.collect()} == plain


def test_one_entity_is_the_work_of_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("all").alias("k"), F.col("id").alias("tick"), (F.col("id") % 7).cast("double").alias("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = scans.prior_expanding_of_slices(df, ["k"], "tick", "y", 500)
        assert made.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert scans.prior_expanding_of_slices(df.limit(0), ["k"], "tick", "y", 500).count() == 0


def test_rolling_features_equal_plain_frames(panel, spark):
    specs = {f"{agg}{w}": ("y", w, agg, least) for agg in ("mean", "std", "sum") for w, least in ((3, 1), (60, 2), (2000, 5), (100_000, 1))}
    plain = panel.withColumns({n: v for name, spec in specs.items() for n, v in zip((name, f"{name}_available"), windows.time_rolling("k", "tick", spec[0], *spec[1:]), strict=True)})
    found = windows.rolling_features(panel, "k", "tick", specs)
    assert found.columns == plain.columns
    a, b = frame(found, "k", "tick"), frame(plain, "k", "tick")
    for c in a.columns[4:]:
        assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-6), c
    # far from zero, and windows of equal values
    flat = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("tick"), (1e9 + F.floor(F.col("id") / 10) % 3).alias("y"))
    rows = windows.rolling_features(flat, "k", "tick", {"s": ("y", 5, "std", 2), "m": ("y", 5, "mean", 2)}).orderBy("tick").toPandas()
    want = pd.Series(rows["y"]).shift(1).rolling(5, min_periods=2)
    assert np.allclose(rows["s"], want.std(ddof=0).fillna(0), atol=1e-4) and np.allclose(rows["m"], want.mean().fillna(0), rtol=1e-13) and (rows["s"] == 0).sum() > 1000


def brute_nearest(points, sites):
    lat, lon = np.radians(np.array([s[1:] for s in sites]).T)
    out = {}
    for i, a, b in points:
        if a is None or b is None:
            out[i] = None
            continue
        p, q = np.radians([a, b])
        h = np.sin((lat - p) / 2) ** 2 + np.cos(p) * np.cos(lat) * np.sin((lon - q) / 2) ** 2
        out[i] = 2 * joins.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))
    return out


@pytest.mark.parametrize("spread", ["globe", "cluster", "poles", "line"])
def test_sites_in_cells_against_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    n = 2500
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    if spread == "cluster":
        lat[50:], lon[50:] = -33 + rng.normal(0, 0.01, n - 50), 151 + rng.normal(0, 0.01, n - 50)
    elif spread == "poles":
        lat = np.sign(lat) * (89 + rng.random(n))
    elif spread == "line":
        lon = np.where(rng.random(n) < 0.5, -180, 179.5) + rng.random(n) / 2
    sites = [(f"s{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))] + [("again", float(lat[3]), float(lon[3]))]
    points = [(i, float(np.degrees(np.arcsin(a))), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-1, 1, 600), rng.uniform(-180, 180, 600), strict=True))]
    points += [(1000, 90.0, 0.0), (1001, -90.0, 12.0), (1002, 0.0, 180.0), (1003, 0.0, -180.0), (1004, None, 1.0), (1005, 1.0, None), (1006, float(lat[3]), float(lon[3])), (1007, float(lat[3]), float(lon[3]))]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    found = joins.nearest_site(df, spark.createDataFrame([*sites, ("nowhere", None, None)], "site string, lat double, lon double"), few=10).collect()
    want, names = brute_nearest(points, sites), [s[0] for s in sites]
    assert len(found) == len(points)
    for r in found:
        d = want[r["id"]]
        if d is None:
            assert r["site"] is None and r["distance_km"] is None
        else:
            assert r["distance_km"] == pytest.approx(d.min(), abs=0.051) and d[names.index(r["site"])] == pytest.approx(d.min(), abs=1e-6)
    assert {r["site"] for r in found if r["id"] in (1006, 1007)} == {"again"}


def test_nearest_event_of_many(spark):
    rng = np.random.default_rng(3)
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(int(n))
    dates, held = [day(n) for n in rng.integers(0, 9000, 800)], sorted({day(n) for n in rng.integers(0, 9000, 300)})
    df = spark.createDataFrame([(i, d) for i, d in enumerate([*dates, None])], "id long, d date")
    found = {r["id"]: (r["event_date"], r["gap_days"]) for r in joins.nearest_event_window(df, "d", spark.createDataFrame([(e,) for e in [*held, held[0], None]], "event_date date"), 12).collect()}
    want = {}
    for i, d in enumerate(dates):
        gap, e = min((abs((d - e).days), e) for e in held)
        if gap <= 12:
            want[i] = (e, (d - e).days)
    assert found == want and 0 < len(want) < 800
