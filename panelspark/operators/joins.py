"""Joins of panels with sources, dimensions, places and events."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import dealt, saved
from .quality import check_unique, require

EARTH_KM = 6371.0088


def left_time_join(driver: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    return driver.join(side, list(keys), "left")


def panel_join(drivers: DataFrame, registry: DataFrame, weather: DataFrame, target: DataFrame, time_keys: Sequence[str], entity: str = "k", both: bool = False) -> DataFrame:
    """The ingest as one plan: each entity's weather and target source come from the registry (entity,
    weather_source, target_source and metadata), their readings by equality on source and time.

    An entity without a target source keeps NULL targets. both keeps only entities that have both
    sources. has_target says whether an entity has any target reading."""
    keys = list(time_keys)
    known = registry.filter(F.col("weather_source").isNotNull() & F.col("target_source").isNotNull()) if both else registry
    rows = drivers.join(known, entity).join(weather.withColumnRenamed("source", "weather_source"), ["weather_source", *keys], "left")
    rows = rows.join(target.withColumnRenamed("source", "target_source"), ["target_source", *keys], "left")
    targets = [c for c in target.columns if c not in ("source", *keys)]
    some = rows.groupBy(entity).agg(F.max(F.col(targets[0]).isNotNull()).alias("has_target"))
    return rows.join(some, entity)


def borrow_column(df: DataFrame, donors: DataFrame, column: str, entity: str, keys: Sequence[str]) -> DataFrame:
    """An entity whose column is NULL throughout takes its donor's values at the same keys; `<column>_source`
    names the donor. donors: (entity, donor)."""
    df = saved(df, "rows")  # what made df runs once
    lacking = df.groupBy(entity).agg(F.max(F.col(column).isNotNull()).alias("_has")).filter(~F.col("_has")).select(entity)
    lent = saved(donors.join(lacking, entity), "donors")
    values = dealt(df, entity, *keys).select(F.col(entity).alias("donor"), *keys, F.col(column).alias("_lent")).dropDuplicates(["donor", *keys])
    rows = df.join(lent, entity, "left").join(values, ["donor", *keys], "left")
    given = F.col("donor").isNotNull()
    return rows.withColumns({column: F.when(given, F.col("_lent")).otherwise(F.col(column)), f"{column}_source": F.col("donor")}).select(*df.columns, f"{column}_source")


def dimension_join_checked(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Many-to-one join; raises on repeated keys of dim and on rows that it doesn't know."""
    require(check_unique(dim, [on]))
    missing = df.join(dim, on, "left_anti").limit(1)
    require(missing.select(F.lit("unmatched").alias("check"), F.lit(1).cast("long").alias("violations")))
    return df.join(dim, on)


def one_to_one_join_checked(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; raises on repeated keys of either side."""
    require(check_unique(a, keys))
    require(check_unique(b, keys))
    return a.join(b, list(keys), "left")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


#: Sites that go to the tasks as one array; more are dealt to cells.
FEW_SITES = 1000


def nearest_site(points: DataFrame, sites: DataFrame, assigned: str | None = None, few: int = FEW_SITES) -> DataFrame:
    """Nearest of sites (site, lat, lon) to each of points (id, lat, lon): site and distance_km to 0.1; of equally near ones the
    first by name.

    Every point stays, equal ones too; without sites, or without a place, site and distance are NULL. With assigned, flag is OK if one of the
    assigned name (up to " (") and the found one contains the other, whatever the case, else REVIEW.

    Up to `few` sites go to the tasks as one array; more are looked for in cells (nearest_by_cells)."""
    there = sites.select(F.col("site").alias("_site"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).dropna(subset=["_lat", "_lon"])
    if there.limit(few + 1).count() > few:
        places = points.select("lat", "lon").dropna().distinct()
        best = nearest_by_cells(places, there).select(F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), F.struct("d", "s").alias("_b"))
        best = points.join(best, (F.col("lat") == F.col("_plat")) & (F.col("lon") == F.col("_plon")), "left").drop("_plat", "_plon")
    else:
        packed = there.agg(F.collect_list(F.struct("_site", "_lat", "_lon")).alias("_all"))  # few rows, counted above
        far = lambda s: haversine_km(F.col("lat"), F.col("lon"), s["_lat"], s["_lon"])
        known = F.filter(F.transform("_all", lambda s: F.struct(far(s).alias("d"), s["_site"].alias("s"))), lambda x: x["d"].isNotNull())
        best = points.join(F.broadcast(packed)).withColumn("_b", F.array_min(known))
    found = best.select(*points.columns, F.col("_b.s").alias("site"), F.round("_b.d", 1).alias("distance_km"))
    if assigned is None:
        return found
    a, b = F.lower(F.split_part(F.col(assigned), F.lit(" ("), F.lit(1))), F.lower("site")
    return found.withColumn("flag", F.when(F.coalesce(a.contains(b) | b.contains(a), F.lit(False)), "OK").otherwise("REVIEW"))


def nearest_by_cells(places: DataFrame, sites: DataFrame) -> DataFrame:
    """(lat, lon, d, s): nearest of sites (_site, _lat, _lon) to each of places (lat, lon), all different, and its distance in km.

    Places and sites are points of the unit sphere in cubic cells, so that neither poles nor the date line are edges. A place looks in the
    27 cells round its own, an equality join; sites in others are at least a cell's width away, in a straight line. If the
    best one found is nearer it is the nearest; the other places look again in cells of twice the width, at last in all.
    Sites of one place are one. The first width is that of cells with about one site, were they spread evenly."""
    ball = lambda lat, lon: [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]
    axes = ("x", "y", "z")
    there = sites.groupBy("_lat", "_lon").agg(F.min("_site").alias("_site"))
    there = saved(there.withColumns(dict(zip([f"_{a}" for a in axes], ball(F.col("_lat"), F.col("_lon")), strict=True))), "sites")
    todo = saved(places.withColumns(dict(zip(axes, ball(F.col("lat"), F.col("lon")), strict=True))), "places")
    width = min(2.0, (4 * math.pi / max(there.count(), 1)) ** 0.5)
    found = None
    while True:
        cell = lambda c, w=width: F.floor(c / w).cast("long")
        near = todo
        for a in axes:
            near = near.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(a)) - 1, cell(F.col(a)) + 1)))
        own = there.withColumns({f"c{a}": cell(F.col(f"_{a}")) for a in axes})
        met = near.join(own, [f"c{a}" for a in axes])
        best = met.groupBy("lat", "lon").agg(F.min(F.struct(haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("d"), F.col("_site").alias("s"))).alias("b"))
        best = best.select("lat", "lon", "b.d", "b.s")
        last = width >= 2.0
        if not last:  # an arc over a chord of the cell's width, less rounding
            best = best.filter(F.col("d") < 2 * EARTH_KM * math.asin(width / 2) * (1 - 1e-9) - 1e-6)
        best = saved(best, "nearest")
        found = best if found is None else found.unionByName(best)
        if last:
            return found
        todo = saved(todo.join(best, ["lat", "lon"], "left_anti"), "places")
        if todo.isEmpty():
            return found
        width = min(2.0, 2 * width)


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return r * F.radians(lon), r * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def nearest_segment(points: DataFrame, polylines: DataFrame, radius_m: float) -> DataFrame:
    """Nearest of polylines (segment_id, points array<struct<x,y>>) within radius_m of each of points
    (id, x, y): segment_id and distance_m, NULL beyond.

    Pieces of polylines are dealt to the cells, as wide as the radius, that their box grown by the
    radius touches; a point looks in its own cell only. That is an equality join and scales with
    density; a piece much longer than the radius takes as many cells as its box."""
    n = F.size("points")
    pieces = polylines.select("segment_id", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b")))).alias("s"))
    pieces = pieces.select("segment_id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    cell = lambda c: F.floor(c / radius_m).cast("long")
    span = lambda a, b: F.sequence(cell(F.least(a, b) - radius_m), cell(F.greatest(a, b) + radius_m))
    pieces = pieces.withColumn("cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"))))
    met = points.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))}).join(pieces, ["cx", "cy"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    along = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / length)))
    met = met.withColumn("_d", F.hypot(F.col("x") - (F.col("x1") + along * dx), F.col("y") - (F.col("y1") + along * dy))).filter(F.col("_d") <= radius_m)
    best = met.groupBy("id").agg(F.min(F.struct("_d", "segment_id")).alias("_b")).select("id", F.col("_b.segment_id").alias("segment_id"), F.col("_b._d").alias("distance_m"))
    return points.join(best, "id", "left")


def nearest_event_window(df: DataFrame, date: str, events: DataFrame, max_days: int) -> DataFrame:
    """Rows within max_days of an event (event_date): the nearest one, the earlier of equally near, and gap_days.

    Each event, however many there are, is dealt to the days that it may be nearest to; a day keeps its nearest one, and
    rows meet it by their day. Nothing holds all events."""
    day = F.explode(F.sequence(F.date_sub("event_date", max_days), F.date_add("event_date", max_days)))
    days = events.select("event_date").dropna().distinct().select("event_date", day.alias("_day"))
    near = days.groupBy("_day").agg(F.min(F.struct(F.abs(F.datediff("_day", "event_date")).alias("gap"), F.col("event_date").alias("event"))).alias("_n"))
    rows = df.join(near, F.to_date(F.col(date)) == F.col("_day"))
    return rows.select(*df.columns, F.col("_n.event").alias("event_date"), F.datediff(F.col("_day"), F.col("_n.event")).alias("gap_days"))


def calendar_flag(df: DataFrame, date: str, holidays: DataFrame, name: str) -> DataFrame:
    """0/1: whether date is among holidays (date)."""
    marks = holidays.select(F.col("date").alias(date)).distinct().withColumn(name, F.lit(1))
    return df.join(marks, date, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def exclude_entities(df: DataFrame, exclusions: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """Rows of other entities, and a ledger (entity, reason, rows_removed) of those excluded."""
    kept = df.join(exclusions, entity, "left_anti")
    counts = df.groupBy(entity).agg(F.count("*").alias("n"))
    ledger = exclusions.join(counts, entity, "left").select(entity, "reason", F.coalesce("n", F.lit(0)).alias("rows_removed"))
    return kept, ledger


def align_predictions(predictions: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """(check, violations): rows of one side only, and targets that differ by more than 1e-8 + 1e-5 of theirs."""
    both = predictions.select(*key, F.col("y_true").alias("_p")).withColumn("_in_p", F.lit(1)).join(
        truth.select(*key, F.col("y_true").alias("_t")).withColumn("_in_t", F.lit(1)), list(key), "full"
    )
    off = F.abs(F.col("_p") - F.col("_t")) > 1e-8 + 1e-5 * F.abs("_t")
    counts = both.agg(F.count_if(F.col("_in_t").isNull()).alias("unknown_rows"), F.count_if(F.col("_in_p").isNull()).alias("missing_rows"), F.count_if(off).alias("different_target"))
    return counts.unpivot([], counts.columns, "check", "violations")
