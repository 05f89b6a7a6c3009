"""Queries of joins (O-J), aggregations and statistics (O-A), and sources (O-S)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import stats as A
from ..operators.gram import gram
from ..operators.reshape import HOURS
from ..shipping import shared_dir
from ..sources import tables as T
from .q_scalars import _wide, r6
from .testbed import query


def _rounded(df, keys, digits=6):
    """df with its doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") and c not in keys else F.col(c) for c in df.columns])


@query("O_J1_left_time_join", "SELECT a.k, a.tick, round(a.y, 6) AS y, round(b.y, 6) AS other FROM daily a LEFT JOIN (SELECT tick, y FROM daily WHERE k = 1) b ON a.tick = b.tick")
def _(t):
    side = t.daily.filter("k = 1").select("tick", F.col("y").alias("other"))
    return J.left_time_join(t.daily.select("k", "tick", "y"), side, ["tick"]).select("k", "tick", r6(F.col("y"), "y"), r6(F.col("other"), "other"))


@query("O_J2_panel_join", """WITH reg AS (SELECT s_suppkey AS k, s_nationkey % 3 AS weather_source, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey % 5 END AS target_source, s_name AS name FROM supplier),
    w AS (SELECT k AS source, d, wind FROM daily), g AS (SELECT k AS source, d, rain AS target FROM daily),
    j AS (SELECT a.k, a.d, a.x, r.name, w.wind, g.target FROM daily a JOIN reg r ON a.k = r.k LEFT JOIN w ON w.source = r.weather_source AND w.d = a.d LEFT JOIN g ON g.source = r.target_source AND g.d = a.d)
    SELECT k, d, round(x, 6) AS x, name, round(wind, 6) AS wind, round(target, 6) AS target, bool_or(target IS NOT NULL) OVER (PARTITION BY k) AS has_target FROM j""")
def _(t):
    reg = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 3).cast("long").alias("weather_source"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") % 5).cast("long").alias("target_source"), F.col("s_name").alias("name"))
    w = t.daily.select(F.col("k").alias("source"), "d", "wind")
    g = t.daily.select(F.col("k").alias("source"), "d", F.col("rain").alias("target"))
    out = J.panel_join(t.daily.select("k", "d", "x"), reg, w, g, ["d"])
    return out.select("k", "d", r6(F.col("x"), "x"), "name", r6(F.col("wind"), "wind"), r6(F.col("target"), "target"), "has_target")


@query("O_J3_borrow_column", """WITH p AS (SELECT k, d, CASE WHEN k % 3 = 0 THEN NULL ELSE gappy END AS v FROM daily)
    SELECT p.k, p.d, round(CASE WHEN p.k % 3 = 0 AND p.k + 1 <= (SELECT max(k) FROM daily) THEN q.v ELSE p.v END, 6) AS v, CASE WHEN p.k % 3 = 0 THEN p.k + 1 END AS v_source FROM p LEFT JOIN p q ON p.k % 3 = 0 AND q.k = p.k + 1 AND q.d = p.d""")
def _(t):
    rows = t.daily.select("k", "d", F.when(F.col("k") % 3 != 0, F.col("gappy")).alias("v"))
    donors = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") + 1).alias("donor"))
    return J.borrow_column(rows, donors, "v", "k", ["d"]).select("k", "d", r6(F.col("v"), "v"), "v_source")


@query("O_J4_dimension_join_checked", "SELECT a.row_id, m.road, m.place FROM daily a JOIN dim m ON a.k = m.k")
def _(t):
    return J.dimension_join_checked(t.daily.select("row_id", "k"), t.dim.select("k", "road", "place"), "k").select("row_id", "road", "place")


@query("O_J5_one_to_one_join_checked", "SELECT a.row_id, round(a.x, 6) AS x, round(b.y, 6) AS y FROM daily a LEFT JOIN (SELECT row_id, y FROM daily WHERE kind <> 2) b ON a.row_id = b.row_id")
def _(t):
    out = J.one_to_one_join_checked(t.daily.select("row_id", "x"), t.daily.filter("kind <> 2").select("row_id", "y"), ["row_id"])
    return _rounded(out, ["row_id"])


@query("O_J6_nearest_site", """WITH c AS (SELECT p.id, s.site, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) AS km, n.n_name AS assigned FROM places p CROSS JOIN sites s JOIN nation n ON n.n_nationkey = p.s_nationkey)
    SELECT id, site, round(km, 1) AS distance_km, CASE WHEN contains(lower(site), lower(assigned)) OR contains(lower(assigned), lower(site)) THEN 'OK' ELSE 'REVIEW' END AS flag FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, site) = 1""")
def _(t):
    points = t.places.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("id", "lat", "lon", F.concat("n_name", F.lit(" (given)")).alias("assigned"))
    return J.nearest_site(points, t.sites, "assigned").select("id", "site", "distance_km", "flag")


#: Places all over the globe, customers as points and parts as sites, in SQL and as columns.
_GLOBE = "-90 + CAST({0} * 7919 % 18001 AS DOUBLE) / 100 AS lat, -180 + CAST({0} * 104729 % 36001 AS DOUBLE) / 100 AS lon"


@query("O_J6_nearest_of_many_sites", f"""WITH p AS (SELECT c_custkey AS id, {_GLOBE.format("c_custkey")} FROM customer), s AS (SELECT p_partkey AS site, {_GLOBE.format("(p_partkey * 31 + 7)")} FROM part),
    c AS (SELECT p.id, s.site, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) AS km FROM p CROSS JOIN s)
    SELECT id, CAST(arg_min(site, round(km, 9)) AS VARCHAR) AS site, round(min(km), 1) AS distance_km FROM c GROUP BY id""")
def _(t):
    globe = lambda key: [(-90 + (key * 7919 % 18001).cast("double") / 100).alias("lat"), (-180 + (key * 104729 % 36001).cast("double") / 100).alias("lon")]
    points = t.customer.select(F.col("c_custkey").alias("id"), *globe(F.col("c_custkey")))
    sites = t.part.select(F.col("p_partkey").cast("string").alias("site"), *globe(F.col("p_partkey") * 31 + 7))
    return J.nearest_site(points, sites, few=100).select("id", "site", "distance_km")


@query("O_J7_nearest_segment", """WITH p AS (SELECT o_orderkey AS id, CAST(o_orderkey * 7919 % 20000 AS DOUBLE) AS x, CAST(o_custkey * 104729 % 20000 AS DOUBLE) AS y FROM orders),
    l AS (SELECT n_nationkey AS segment_id, CAST(n_nationkey * 800 AS DOUBLE) AS x1, 0.0 AS y1, CAST(n_nationkey * 700 + 500 AS DOUBLE) AS x2, 9000.0 AS y2, CAST(n_nationkey * 900 AS DOUBLE) AS x3, 20000.0 AS y3 FROM nation),
    s AS (SELECT segment_id, x1, y1, x2, y2 FROM l UNION ALL SELECT segment_id, x2, y2, x3, y3 FROM l),
    c AS (SELECT id, segment_id, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS a FROM p, s),
    m AS (SELECT id, segment_id, sqrt(pow(x - (x1 + a * (x2 - x1)), 2) + pow(y - (y1 + a * (y2 - y1)), 2)) AS dist FROM c), b AS (SELECT * FROM m WHERE dist <= 150 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(dist, 6), segment_id) = 1)
    SELECT p.id, b.segment_id, round(b.dist, 4) AS distance_m FROM p LEFT JOIN b ON p.id = b.id""")
def _(t):
    points = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % 20000).cast("double").alias("x"), (F.col("o_custkey") * 104729 % 20000).cast("double").alias("y"))
    n = F.col("n_nationkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    lines = t.nation.select(n.alias("segment_id"), F.array(corner(n * 800, 0), corner(n * 700 + 500, 9000), corner(n * 900, 20000)).alias("points"))
    return J.nearest_segment(points, lines, 150.0).select("id", "segment_id", F.round("distance_m", 4).alias("distance_m"))


@query("O_J8_nearest_event_window", """WITH c AS (SELECT a.row_id, h.date AS event_date, CAST(a.d - h.date AS INTEGER) AS gap_days FROM daily a CROSS JOIN holidays h) SELECT row_id, event_date, gap_days FROM c WHERE abs(gap_days) <= 30 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(gap_days), event_date) = 1""")
def _(t):
    return J.nearest_event_window(t.daily.select("row_id", "d"), "d", t.holidays.withColumnRenamed("date", "event_date"), 30).select("row_id", "event_date", "gap_days")


@query("O_J9_calendar_flag", "SELECT row_id, CAST(d IN (SELECT date FROM holidays) AS INTEGER) AS holiday FROM daily")
def _(t):
    return J.calendar_flag(t.daily.select("row_id", "d"), "d", t.holidays, "holiday").select("row_id", "holiday")


def _exclusions(t):
    return t.supplier.filter("s_acctbal < 0 OR s_suppkey % 20 = 3").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") < 0, "negative balance").otherwise("chosen").alias("reason"))


_EXCLUSIONS = "SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN 'negative balance' ELSE 'chosen' END AS reason FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 20 = 3"


@query("O_J10_exclude_entities", f"WITH e AS ({_EXCLUSIONS}) SELECT 'kept' AS part, k, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM daily WHERE k NOT IN (SELECT k FROM e) GROUP BY k UNION ALL SELECT 'ledger', e.k, e.reason, count(d.k) FROM e LEFT JOIN daily d ON d.k = e.k GROUP BY e.k, e.reason")
def _(t):
    kept, ledger = J.exclude_entities(t.daily, _exclusions(t), "k")
    rows = kept.groupBy("k").agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "k", F.lit(None).cast("string").alias("reason"), "n")
    return rows.unionByName(ledger.select(F.lit("ledger").alias("part"), "k", "reason", F.col("rows_removed").alias("n")))


@query("O_J11_align_predictions", """SELECT 'unknown_rows' AS "check", CAST(count_if(row_id % 97 = 0 AND row_id % 89 <> 0) AS BIGINT) AS violations FROM daily UNION ALL SELECT 'missing_rows', CAST(count_if(row_id % 89 = 0 AND row_id % 97 <> 0) AS BIGINT) FROM daily UNION ALL SELECT 'different_target', CAST(count_if(row_id % 83 = 0 AND row_id % 97 <> 0 AND row_id % 89 <> 0) AS BIGINT) FROM daily""")
def _(t):
    y = F.when(F.col("row_id") % 83 == 0, F.col("y") + 1).otherwise(F.col("y")).alias("y_true")
    return J.align_predictions(t.daily.filter("row_id % 89 <> 0").select("row_id", y), t.daily.filter("row_id % 97 <> 0").select("row_id", F.col("y").alias("y_true")), ["row_id"])


@query("O_A1_daily_rollup", "SELECT k, d, round(avg(y), 6) AS y, round(sum(x), 6) AS x_rain FROM hourly GROUP BY k, d")
def _(t):
    return _rounded(A.daily_rollup(t.hourly.withColumnRenamed("x", "x_rain"), ["k", "d"], ["y", "x_rain"], ["RAIN"]), ["k"])


@query("O_A2_directional_summary", """WITH p AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, event_type AS c, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY ALL),
    s AS (SELECT k, d, sum(v) AS total, count(*) AS n_directions, max(v) AS mx, min(v) AS mn, coalesce(sum(v) FILTER (WHERE c = 'click'), 0) AS cl, coalesce(sum(v) FILTER (WHERE c = 'view'), 0) AS vi FROM p GROUP BY k, d)
    SELECT k, d, total, n_directions, CAST(n_directions >= 2 AS INTEGER) AS is_bidirectional, CASE WHEN total = 0 THEN 0.0 ELSE round(mx / total, 6) END AS dominant_share, CASE WHEN n_directions >= 2 AND total <> 0 THEN round((mx - mn) / total, 6) ELSE 0.0 END AS imbalance,
    CASE WHEN total = 0 THEN 0.0 ELSE round(cl / total, 6) END AS share_click, CASE WHEN total = 0 THEN 0.0 ELSE round(vi / total, 6) END AS share_view FROM s""")
def _(t):
    rows = t.events.select(F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "event_type", F.round(F.col("value") * 100).cast("long").cast("double").alias("v"))
    return _rounded(A.directional_summary(rows, ["k", "d"], "event_type", "v", ["click", "view"]), ["total"])


@query("O_A3_coverage_flag", "SELECT row_id, bool_or(gappy IS NOT NULL AND k % 3 <> 0) OVER (PARTITION BY k) AS has_coverage FROM daily")
def _(t):
    rows = t.daily.withColumn("z", F.when(F.col("k") % 3 != 0, F.col("gappy")))
    return A.coverage_flag(rows, "k", "z").select("row_id", "has_coverage")


@query("O_A4_thin_slots", """WITH z AS (SELECT CAST(month(d) AS INTEGER) AS m, CASE WHEN month(d) = 3 AND kind <> 0 THEN NULL ELSE gappy END AS v FROM daily), s AS (SELECT m, avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM z GROUP BY m)
    SELECT m, round(share, 6) AS share, share < 0.6 * (SELECT quantile_cont(share, 0.5) FROM s) AS is_thin FROM s""")
def _(t):
    rows = t.daily.select(F.month("d").alias("m"), F.when(~((F.month("d") == 3) & (F.col("kind") != 0)), F.col("gappy")).alias("v"))
    return _rounded(A.thin_slots(rows, ["m"], "v"), [])


@query("O_A5_thin_entities", "SELECT k, count(*) AS n, count(*) / 2.0 < 260 AS is_thin FROM daily GROUP BY k")
def _(t):
    return A.thin_entities(t.daily, "k", 260, 2)


@query("O_A6_train_median", "SELECT round(quantile_cont(gappy, 0.5), 6) AS gappy FROM marked WHERE split = 'train'")
def _(t):
    return _rounded(A.train_median(t.marked, "gappy"), [])


@query("O_A7_missing_report", """SELECT 'gappy' AS "column", round(100.0 * avg(CASE WHEN gappy IS NULL THEN 1.0 ELSE 0.0 END), 2) AS before_pct, round(100.0 * avg(CASE WHEN gappy IS NULL AND kind <> 1 THEN 1.0 ELSE 0.0 END), 2) AS after_pct FROM daily UNION ALL SELECT 'x', 0.0, 0.0 FROM (SELECT count(*) FROM daily) c""")
def _(t):
    after = t.daily.withColumn("gappy", F.when(F.col("kind") == 1, F.coalesce("gappy", F.lit(0.0))).otherwise(F.col("gappy")))
    return A.missing_report(t.daily, after, ["gappy", "x"])


@query("O_A8_cleaning_ledger", """WITH s AS (SELECT k, true AS s0, k % 10 <> 3 AS s1, k % 10 <> 3 AND gappy IS NOT NULL AS s2, k % 10 <> 3 AND gappy IS NOT NULL AND x >= 10 AS s3 FROM daily),
    c AS (SELECT count(*) AS n0, CAST(count_if(s1) AS BIGINT) AS n1, CAST(count_if(s2) AS BIGINT) AS n2, CAST(count_if(s3) AS BIGINT) AS n3, count(DISTINCT CASE WHEN s1 THEN k END) AS e1, count(DISTINCT CASE WHEN s2 THEN k END) AS e2, count(DISTINCT CASE WHEN s3 THEN k END) AS e3 FROM s)
    SELECT 1 AS step_order, 'excluded' AS step, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_removed, e1 AS entities_after FROM c UNION ALL SELECT 2, 'no sensor', n1, n2, n1 - n2, e2 FROM c UNION ALL SELECT 3, 'small', n2, n3, n2 - n3, e3 FROM c""")
def _(t):
    return A.cleaning_ledger(t.daily, "k", [("excluded", F.col("k") % 10 != 3), ("no sensor", F.col("gappy").isNotNull()), ("small", F.col("x") >= 10)])


@query("O_A9_iqr_outliers", """WITH q AS (SELECT k, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM daily GROUP BY k), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
    SELECT f.k, round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high, count(y) AS n, CAST(count_if(y < low OR y > high) AS BIGINT) AS n_outliers, round(100.0 * count_if(y < low OR y > high) / count(y), 6) AS pct_outliers FROM daily d JOIN f ON d.k = f.k GROUP BY f.k, q1, q3, low, high""")
def _(t):
    return _rounded(A.iqr_outliers(t.daily, "k", "y"), [])


@query("O_A10_split_summary", """WITH e AS (SELECT split, k, count(*) AS n, stddev_samp(y) AS s FROM marked GROUP BY split, k), i AS (SELECT split, count(*) AS entities, avg(s) AS w, avg(n) AS r FROM e GROUP BY split)
    SELECT m.split, count(*) AS "rows", min(d) AS first_t, max(d) AS last_t, round(avg(y), 5) AS mean_y, round(stddev_samp(y), 5) AS sd_y, any_value(i.entities) AS entities, round(any_value(i.w), 5) AS mean_within_sd, round(any_value(i.r), 5) AS rows_per_entity FROM marked m JOIN i ON m.split = i.split GROUP BY m.split""")
def _(t):
    return _rounded(A.split_summary(t.marked, "split", "k", "d", "y"), [], 5)


@query("O_A11_feature_inventory", """WITH f AS (SELECT DISTINCT p_brand || ' ' || p_type AS feature, p_type AS family, CAST(contains(p_brand, '3') AS INTEGER) AS kept FROM part) SELECT family, count(*) AS candidates, CAST(count_if(kept = 0) AS BIGINT) AS pruned, CAST(count_if(kept = 1) AS BIGINT) AS n_kept, coalesce(string_agg(feature, '; ' ORDER BY feature) FILTER (WHERE kept = 1), '') AS names FROM f GROUP BY family""")
def _(t):
    return A.feature_inventory(t.part.select(F.concat_ws(" ", "p_brand", "p_type").alias("feature"), F.col("p_type").alias("family"), F.col("p_brand").contains("3").cast("int").alias("kept")).distinct())


@query("O_A12_field_profile", """SELECT 'k' AS "column", 'bigint' AS type, count(k) AS non_null, round(100.0 * (count(*) - count(k)) / count(*), 2) AS missing_pct, min(CAST(k AS VARCHAR)) AS example FROM daily UNION ALL SELECT 'd', 'date', count(d), round(100.0 * (count(*) - count(d)) / count(*), 2), min(CAST(d AS VARCHAR)) FROM daily UNION ALL SELECT 'gap', 'int', count(gappy), round(100.0 * (count(*) - count(gappy)) / count(*), 2), min(CAST(CAST(floor(gappy) AS INTEGER) AS VARCHAR)) FROM daily""")
def _(t):
    return A.field_profile(t.daily.select("k", "d", F.floor("gappy").cast("int").alias("gap")))


@query("O_A13_normalised_profile", "WITH m AS (SELECT k, kind, avg(y) AS mean FROM daily GROUP BY k, kind) SELECT k, kind, round(mean, 5) AS mean, round(100 * mean / avg(mean) OVER (PARTITION BY k), 5) AS pct FROM m")
def _(t):
    return _rounded(A.normalised_profile(t.daily, "k", "kind", "y"), [], 5)


@query("O_A14_monthly_rollup", "SELECT kind, CAST(date_trunc('month', d) AS DATE) AS month, round(avg(y), 5) AS mean_y, round(avg(wind), 5) AS mean_wind, round(sum(x), 5) AS sum_x FROM daily GROUP BY kind, CAST(date_trunc('month', d) AS DATE)")
def _(t):
    return _rounded(A.monthly_rollup(t.daily, "d", ["y", "wind"], ["x"], ["kind"]), [], 5)


@query("O_A15_entity_summary", "SELECT d.k, round(avg(x), 5) AS mean_x, round(avg(y), 5) AS mean_y, min(m.road) AS road, min(m.place) AS place FROM daily d JOIN dim m ON d.k = m.k GROUP BY d.k")
def _(t):
    return _rounded(A.entity_summary(t.daily.join(t.dim, "k"), "k", ["x", "y"], ["road", "place"]), [], 5)


@query("O_A16_distribution_stats", """WITH m AS (SELECT avg(y) AS m FROM daily), p AS (SELECT avg(pow(y - m, 2)) AS a, avg(pow(y - m, 3)) AS b, avg(pow(y - m, 4)) AS c FROM daily, m)
    SELECT count(y) AS n, round(avg(y), 5) AS mean, round(stddev_samp(y), 5) AS sd, round(quantile_cont(y, 0.25), 5) AS q1, round(quantile_cont(y, 0.5), 5) AS median, round(quantile_cont(y, 0.75), 5) AS q3, round(any_value(b / pow(a, 1.5)), 5) AS skew, round(any_value(c / (a * a) - 3), 5) AS excess_kurtosis FROM daily, p""")
def _(t):
    return _rounded(A.distribution_stats(t.daily, "y"), [], 5)


@query("O_A17_boxplot_stats", """WITH q AS (SELECT k, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM daily GROUP BY k),
    w AS (SELECT q.k, q1, median, q3, min(y) FILTER (WHERE y >= q1 - 1.5 * (q3 - q1)) AS lo, max(y) FILTER (WHERE y <= q3 + 1.5 * (q3 - q1)) AS hi FROM daily d JOIN q ON d.k = q.k GROUP BY q.k, q1, median, q3)
    SELECT k, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lo, 6) AS whisker_low, round(hi, 6) AS whisker_high, CAST(row_number() OVER (ORDER BY w.median DESC, k) AS INTEGER) AS place FROM w""")
def _(t):
    return _rounded(A.boxplot_stats(t.daily, "k", "y"), [])


@query("O_A18_pearson_tests", """SELECT 'x' AS variable, round(corr(x, y), 6) AS r, count(*) AS n FROM daily UNION ALL SELECT 'gappy', round(corr(gappy, y), 6), count(gappy) FROM daily UNION ALL SELECT 'rain', round(corr(rain, y), 6), count(*) FROM daily""")
def _(t):
    return A.pearson_tests(t.daily, ["x", "gappy", "rain"], "y").select("variable", r6(F.col("r"), "r"), "n")


@query("O_A19_corr_matrix", """WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings) SELECT 'e0' AS a, 'e1' AS b, round(corr(e0, e1), 6) AS r FROM e UNION ALL SELECT 'e0', 'e2', round(corr(e0, e2), 6) FROM e UNION ALL SELECT 'e1', 'e2', round(corr(e1, e2), 6) FROM e""")
def _(t):
    rows = t.embeddings.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)])
    return _rounded(A.corr_matrix(rows, ["e0", "e1", "e2"]), [])


@query("O_A20_group_corr", "SELECT k, count(gappy) AS n, round(corr(gappy, y), 6) AS r, round(regr_slope(y, gappy), 6) AS slope, round(regr_intercept(y, gappy), 6) AS intercept FROM daily GROUP BY k")
def _(t):
    return _rounded(A.group_corr(t.daily, "k", "gappy", "y"), [])


_GROUP_R = "SELECT k, corr(gappy, y) AS r FROM daily GROUP BY k"


@query("O_A20_corr_by_attribute", f"SELECT count(*) AS groups, round(corr(r, acct), 6) AS corr, round(regr_slope(r, acct) * 1000, 6) AS slope, round(regr_intercept(r, acct), 6) AS intercept FROM ({_GROUP_R}) c JOIN dim ON dim.k = c.k WHERE r IS NOT NULL AND NOT isnan(r)")
def _(t):
    out = A.corr_by_attribute(A.group_corr(t.daily, "k", "gappy", "y"), t.dim, "k", "r", "acct")
    return _rounded(out.withColumn("slope", F.col("slope") * 1000), [])


@query("O_A20_describe_by", f"""WITH c AS (SELECT c.k, r, acct > 5000 AS flag FROM ({_GROUP_R}) c JOIN dim ON dim.k = c.k WHERE NOT isnan(r))
    SELECT flag, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(min(r), 6) AS least, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS q3, round(max(r), 6) AS largest FROM c GROUP BY flag""")
def _(t):
    rows = A.group_corr(t.daily, "k", "gappy", "y").join(t.dim.select("k", (F.col("acct") > 5000).alias("flag")), "k")
    return _rounded(A.describe_by(rows, "flag", "r"), [])


@query("O_A21_welch_t", """WITH s AS (SELECT avg(y) FILTER (WHERE flag = 1) AS m1, avg(y) FILTER (WHERE flag = 0) AS m0, var_samp(y) FILTER (WHERE flag = 1) / count(*) FILTER (WHERE flag = 1) AS a, var_samp(y) FILTER (WHERE flag = 0) / count(*) FILTER (WHERE flag = 0) AS b, count(*) FILTER (WHERE flag = 1) AS n1, count(*) FILTER (WHERE flag = 0) AS n0 FROM daily)
    SELECT round(m1, 5) AS mean_1, round(m0, 5) AS mean_0, round((m1 - m0) / sqrt(a + b), 5) AS t, round(pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 3) AS df FROM s""")
def _(t):
    out = A.welch_t(t.daily, "y", "flag")
    return out.select(*[F.round(c, 5).alias(c) for c in ("mean_1", "mean_0", "t")], F.round("df", 3).alias("df"))


@query("O_A22_within_group_change", """WITH m AS (SELECT k, avg(y) FILTER (WHERE flag = 0) AS a, avg(y) FILTER (WHERE flag = 1) AS b FROM daily GROUP BY k), d AS (SELECT *, b - a AS d FROM m WHERE a IS NOT NULL AND b IS NOT NULL),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0) SELECT 'y' AS "column", (SELECT count(*) FROM d) AS n, (SELECT round(quantile_cont(100 * d / a, 0.5), 5) FROM d) AS median_pct, round(least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)), 5) AS w FROM r""")
def _(t):
    out = A.within_group_change(t.daily, "k", "flag", ["y"])
    return _rounded(out.select("column", "n", "median_pct", "w"), [], 5)


@query("O_A23_gram", """WITH z AS (SELECT kind, 1.0 AS one, x, wind AS w2, y, rain + 1 AS w FROM daily) SELECT CAST(kind AS VARCHAR) AS g, 0 AS i, 0 AS j, round(sum(w), 4) AS value FROM z GROUP BY kind UNION ALL SELECT CAST(kind AS VARCHAR), 0, 1, round(sum(w * x), 4) FROM z GROUP BY kind UNION ALL SELECT CAST(kind AS VARCHAR), 0, 2, round(sum(w * w2), 4) FROM z GROUP BY kind
    UNION ALL SELECT CAST(kind AS VARCHAR), 0, 3, round(sum(w * y), 4) FROM z GROUP BY kind UNION ALL SELECT CAST(kind AS VARCHAR), 1, 1, round(sum(w * x * x), 4) FROM z GROUP BY kind UNION ALL SELECT CAST(kind AS VARCHAR), 1, 2, round(sum(w * x * w2), 4) FROM z GROUP BY kind UNION ALL SELECT CAST(kind AS VARCHAR), 1, 3, round(sum(w * x * y), 4) FROM z GROUP BY kind
    UNION ALL SELECT CAST(kind AS VARCHAR), 2, 2, round(sum(w * w2 * w2), 4) FROM z GROUP BY kind UNION ALL SELECT CAST(kind AS VARCHAR), 2, 3, round(sum(w * w2 * y), 4) FROM z GROUP BY kind UNION ALL SELECT CAST(kind AS VARCHAR), 3, 3, round(sum(w * y * y), 4) FROM z GROUP BY kind""")
def _(t):
    return _rounded(gram(t.daily.withColumn("w", F.col("rain") + 1), ["x", "wind"], "y", "w", "kind"), [], 4)


@query("O_A24_entity_roster", f"""WITH e AS ({_EXCLUSIONS}), c AS (SELECT k, CAST(count_if(split = 'train') AS BIGINT) AS a, CAST(count_if(split = 'validation') AS BIGINT) AS b, CAST(count_if(split = 'test') AS BIGINT) AS z FROM marked GROUP BY k)
    SELECT s_suppkey AS k, s_name AS name, coalesce(a, 0) AS rows_train, coalesce(b, 0) AS rows_validation, coalesce(z, 0) AS rows_test, e.reason, CASE WHEN e.reason IS NOT NULL THEN 'excluded' WHEN a > 0 AND z > 0 THEN 'train + test' WHEN a > 0 THEN 'train only' ELSE 'no rows' END AS role FROM supplier LEFT JOIN c ON c.k = s_suppkey LEFT JOIN e ON e.k = s_suppkey""")
def _(t):
    return A.entity_roster(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), t.marked, _exclusions(t), "k")


def _folder(t, name):
    """A new shared folder for files that a query writes and reads."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("O_S1_read_wide_hours", "SELECT 'files' AS entity_id, k, d, CAST(count(*) AS BIGINT) AS hours, sum(x) AS total FROM hourly GROUP BY k, d")
def _(t):
    path = _folder(t, "files - wide")
    _wide(t).select("k", "d", *HOURS).write.option("header", True).csv(path)
    rows = T.read_wide_hours(t.spark, path, "k long, d date")
    there = [F.col(h).isNotNull().cast("long") for h in HOURS]
    return rows.select(F.lit("files").alias("entity_id"), "k", "d", sum(there[1:], there[0]).alias("hours"), sum((F.coalesce(h, F.lit(0.0)) for h in HOURS), F.lit(0.0)).alias("total"))


def _monitor(t, layouts):
    """Rows of hourly through files in the monitor's layouts (condition, columns), as many files as tasks, each with a header."""
    path = _folder(t, "monitor")
    for i, (kept, columns) in enumerate(layouts):
        t.hourly.filter(kept).select(*columns).write.option("header", True).csv(f"{path}/{i}")
    read = T.read_monitor_table(t.spark, f"{path}/*", {"target": ["NO2"], "wind": ["WSP"], "ozone": ["OZONE"], "co": ["CO"], "k": ["station"]}, {"co": ["OZONE"]})
    return read.select(F.col("k").cast("long").alias("k"), "date", "hour_ending", F.round("target", 4).alias("target"), F.round("wind", 4).alias("wind"), "ozone", "co")


def _monitor_columns():
    date, time = F.date_format("d", "dd/MM/yyyy").alias("Date"), F.format_string("%02d:00", "h").alias("Time")
    return date, time, F.col("y").alias("NO2 1h average"), F.col("x").alias("WSP m/s"), F.col("k").alias("station")


@query("O_S2_read_monitor_table", "SELECT k, d AS date, h AS hour_ending, round(y, 4) AS target, round(x, 4) AS wind, CAST(NULL AS DOUBLE) AS ozone FROM hourly")
def _(t):
    return _monitor(t, [("true", _monitor_columns())]).drop("co")


@query("O_S2_read_monitor_table_all", "SELECT k, d AS date, h AS hour_ending, round(y, 4) AS target, CASE WHEN k % 3 <> 1 THEN round(x, 4) END AS wind, CASE WHEN k % 3 = 1 THEN x * 2 END AS ozone, CASE WHEN k % 3 = 2 THEN x + 0.5 END AS co FROM hourly")
def _(t):
    """All rows, in three layouts: as above; another order without wind but with ozone; another with a quoted name and CO."""
    date, time, target, wind, k = _monitor_columns()
    ozone = (F.col("x") * 2).alias("Ozone [pphm]")
    return _monitor(t, [
        ("k % 3 = 0", (date, time, target, wind, k)),
        ("k % 3 = 1", (k, ozone, time, date.alias("DATE"), target.alias("no2 [pphm], hourly"))),
        ("k % 3 = 2", (wind.alias("wsp"), (F.col("x") + 0.5).alias("CO ppm"), target.alias('8h "NO2"'), date, k, time)),
    ])


@query("O_S3_read_daily_series", """WITH r AS (SELECT d, sum(n) AS rain FROM daily WHERE kind <> 0 GROUP BY d), a AS (SELECT d, max(k) AS tmax FROM daily WHERE kind = 1 GROUP BY d), b AS (SELECT d, min(k) AS tmin FROM daily WHERE kind = 2 GROUP BY d)
    SELECT coalesce(r.d, a.d, b.d) AS date, CAST(rain AS DOUBLE) AS rain, CAST(tmax AS DOUBLE) AS tmax, CAST(tmin AS DOUBLE) AS tmin, CASE WHEN tmax IS NOT NULL AND tmin IS NOT NULL THEN (tmax + tmin) / 2.0 ELSE CAST(coalesce(tmax, tmin) AS DOUBLE) END AS temp FROM r FULL JOIN a ON r.d = a.d FULL JOIN b ON coalesce(r.d, a.d) = b.d""")
def _(t):
    path = _folder(t, "series")
    parts = {"rain": ("kind <> 0", F.sum("n")), "tmax": ("kind = 1", F.max("k")), "tmin": ("kind = 2", F.min("k"))}
    for name, (kept, value) in parts.items():
        t.daily.filter(kept).groupBy("d").agg(value.alias("value")).select(F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"), "value").write.option("header", True).csv(f"{path}/{name}")
    return T.read_daily_series(t.spark, {n: f"{path}/{n}" for n in parts}).select("date", "rain", "tmax", "tmin", "temp")


@query("O_S4_read_json_sites", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS lat FROM supplier WHERE s_suppkey % 7 <> 0")
def _(t):
    path = _folder(t, "sites")
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("lat"), F.lit(1.0).alias("lon"))
    parts = rows.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))  # 1,000 ids an array
    parts.write.partitionBy("part").text(path)
    return T.read_json_sites(t.spark, path, "id long, name string, lat double, lon double", "lat", "lon").select("id", "name", "lat")


@query("O_S5_read_reference_subset", "SELECT p_brand, p_name, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def _(t):
    path = _folder(t, "reference")
    t.part.select("p_partkey", "p_brand", "p_name", "p_size").write.option("header", True).csv(path)
    return T.read_reference_subset(t.spark, path, "p_partkey long, p_brand string, p_name string, p_size int", ["p_brand", "p_name", "p_size"], "p_brand", ["p_partkey"])


@query("O_S6_write_table", "SELECT split, count(*) AS n, round(sum(x), 6) AS x FROM marked GROUP BY split")
def _(t):
    path = _folder(t, "table")
    T.write_table(t.marked.select("row_id", "x", "split"), path, ["split"])
    return t.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), r6(F.sum("x"), "x"))


@query("O_S7_stack_tables", "SELECT 'a' AS part, s_suppkey AS key, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT 'b', c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return T.stack_tables([a, t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))], [{"part": "a"}, {"part": "b"}])


@query("O_S8_index_prediction_files", "SELECT model, count(*) AS n, round(sum(y_pred), 4) AS total FROM preds WHERE stage = 'default' GROUP BY model")
def _(t):
    path = _folder(t, "predictions")
    t.preds.filter("stage = 'default'").select("model", "row_id", "y_pred").write.partitionBy("model").parquet(path)
    read = T.index_prediction_files(t.spark, f"{path}/*/*.parquet", r"^model=([^/]+)/(part)-(\d+)", ["model", "kind", "number"], 1)
    named = read.filter("kind = 'part'")
    return named.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("y_pred"), 4).alias("total"))
