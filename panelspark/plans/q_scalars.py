"""Queries of scalar expressions (O-P) and reshaping (O-R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, reshape, scans
from ..operators.features import dispersion_proxy
from .testbed import query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("O_P1_safe_divide", "SELECT row_id, CASE WHEN wind = 0 THEN 0.0 ELSE round(x / wind, 6) END AS ratio FROM daily")
def _(t):
    return t.daily.select("row_id", r6(S.safe_divide(F.col("x"), F.col("wind")), "ratio"))


@query("O_P2_slug", """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name || ' #' || p_type)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM part""")
def _(t):
    return t.part.select("p_partkey", S.slug(F.concat_ws(" #", "p_name", "p_type")).alias("slug"))


_RULES = [("Cool", ["blue", "green", "ECO"]), ("Metal", ["ring", "bolt"])]


@query("O_P3_keyword_bucket", """SELECT p_partkey, CASE WHEN contains(lower(p_name || p_type), 'blue') OR contains(lower(p_name || p_type), 'green') OR contains(lower(p_name || p_type), 'eco') THEN 'Cool'
    WHEN contains(lower(p_name || p_type), 'ring') OR contains(lower(p_name || p_type), 'bolt') THEN 'Metal' ELSE 'Other' END AS bucket FROM part""")
def _(t):
    return t.part.select("p_partkey", S.keyword_bucket(F.concat("p_name", "p_type"), _RULES, "Other").alias("bucket"))


_FAMILIES = [("Calendar", ["status", "flag"]), ("Money", ["price", "discount", "tax"]), ("Keys", ["key"])]


@query("O_P4_name_family", """SELECT name AS feature, CASE WHEN contains(name, 'status') OR contains(name, 'flag') THEN 'Calendar' WHEN contains(name, 'price') OR contains(name, 'discount') OR contains(name, 'tax') THEN 'Money'
    WHEN contains(name, 'key') THEN 'Keys' ELSE 'Other' END AS family, n FROM (SELECT 'l_returnflag' AS name, count(l_returnflag) AS n FROM lineitem UNION ALL SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_partkey', count(l_partkey) FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem) u""")
def _(t):
    names = ["l_returnflag", "l_extendedprice", "l_partkey", "l_quantity"]
    counts = t.lineitem.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n")
    return counts.select("feature", S.name_family(F.col("feature"), _FAMILIES).alias("family"), "n")


@query("O_P5_cyclical", "SELECT row_id, round(sin(2 * pi() * (month(d) - 1) / 12), 6) AS s, round(cos(2 * pi() * (month(d) - 1) / 12), 6) AS c FROM daily")
def _(t):
    s, c = S.cyclical(F.month("d"), 12, 1)
    return t.daily.select("row_id", r6(s, "s"), r6(c, "c"))


@query("O_P6_calendar_features", """WITH first AS (SELECT min(d) AS f FROM hourly), c AS (SELECT k, tick, d, h % 24 AS hour_of_day, CAST(isodow(d) - 1 AS INTEGER) AS weekday, CAST(date_diff('day', f, d) AS INTEGER) AS days_since_start FROM hourly, first)
    SELECT k, tick, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(week(d) AS INTEGER) AS week, CAST(dayofyear(d) AS INTEGER) AS day_of_year, weekday, CAST(weekday >= 5 AS INTEGER) AS is_weekend,
    CAST(weekday < 5 AND d <> DATE '2024-01-15' AS INTEGER) AS is_working_day, days_since_start, hour_of_day, weekday * 24 + hour_of_day AS hour_of_week,
    CAST(hour_of_day BETWEEN 7 AND 9 OR hour_of_day BETWEEN 16 AND 18 AS INTEGER) AS is_peak, CAST(hour_of_day BETWEEN 0 AND 5 AS INTEGER) AS is_overnight, round(sin(2 * pi() * (dayofyear(d) - 1) / 365.25), 6) AS year_day_sin,
    round(cos(2 * pi() * (weekday * 24 + hour_of_day) / 168), 6) AS week_hour_cos FROM c""")
def _(t):
    rows = t.hourly.withColumn("holiday", (F.col("d") == F.lit("2024-01-15").cast("date")).cast("int"))
    out = S.calendar_features(rows, "d", "holiday", "h")
    plain = ["year", "quarter", "week", "day_of_year", "weekday", "is_weekend", "is_working_day", "days_since_start", "hour_of_day", "hour_of_week", "is_peak", "is_overnight"]
    return out.select("k", "tick", *plain, r6(F.col("year_day_sin"), "year_day_sin"), r6(F.col("week_hour_cos"), "week_hour_cos"))


@query("O_P7_season", "SELECT row_id, CASE WHEN month(d) IN (12, 1, 2) THEN 'summer' WHEN month(d) <= 5 THEN 'autumn' WHEN month(d) <= 8 THEN 'winter' ELSE 'spring' END AS season FROM daily")
def _(t):
    return t.daily.select("row_id", S.season(F.month("d")).alias("season"))


@query("O_P8_one_hot", """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "status_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "status_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "status_P", CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "prio_5-LOW" FROM orders""")
def _(t):
    one = S.one_hot(t.orders, "o_orderstatus", "status", ["F", "O", "P"])
    return S.one_hot(one, "o_orderpriority", "prio", ["1-URGENT", "5-LOW"], drop_first=True).select("o_orderkey", "status_F", "status_O", "status_P", "prio_5-LOW")


@query("O_P9_transforms", "SELECT row_id, round(ln(1 + y), 6) AS log1p, round(sqrt(y), 6) AS sqrt, round(y * y, 6) AS square, round(ln(1 + greatest(y - 50, 0)), 6) AS clipped_log1p, round(x * wind, 6) AS x_x_wind FROM daily")
def _(t):
    made = S.transforms(F.col("y"))
    made["clipped_log1p"] = S.transforms(F.col("y") - 50)["clipped_log1p"]
    made |= S.interactions([("x", "wind")])
    return t.daily.select("row_id", *[r6(c, n) for n, c in made.items()])


@query("O_P10_wind_vector", """WITH w AS (SELECT row_id, gappy, CAST(gappy IS NOT NULL AS INTEGER) AS there, radians(CAST(CAST(x * 37 AS BIGINT) % 360 AS DOUBLE)) AS a FROM daily)
    SELECT row_id, CASE WHEN there = 1 THEN round(sin(a), 6) ELSE 0.0 END AS wind_sin, CASE WHEN there = 1 THEN round(cos(a), 6) ELSE 0.0 END AS wind_cos, CASE WHEN there = 1 THEN round(-gappy * sin(a), 6) ELSE 0.0 END AS wind_u,
    CASE WHEN there = 1 THEN round(-gappy * cos(a), 6) ELSE 0.0 END AS wind_v, CASE WHEN there = 1 AND gappy <= 0.5 THEN 1 ELSE 0 END AS wind_calm FROM w""")
def _(t):
    made = S.wind_vector(F.col("gappy"), F.col("x") * 37, F.col("gappy").isNotNull().cast("int"))
    return t.daily.select("row_id", *[(r6(c, n) if n != "wind_calm" else c.alias(n)) for n, c in made.items()])


@query("O_P11_dispersion_proxy", """WITH m AS (SELECT quantile_cont(gappy, 0.5) AS m FROM marked WHERE split = 'train')
    SELECT row_id, round(ln(1 + x) / (1 + coalesce(gappy, m)), 6) AS proxy FROM marked, m""")
def _(t):
    return dispersion_proxy(t.marked, "x", "gappy").select("row_id", r6("proxy", "proxy"))


@query("O_P12_rain_flags", "SELECT row_id, CAST(rain > 1 AS INTEGER) AS rain_wet, CAST(rain > 10 AS INTEGER) AS rain_heavy, round(ln(1 + greatest(rain, 0)), 6) AS rain_log1p FROM daily")
def _(t):
    made = S.rain_flags(F.col("rain"))
    return t.daily.select("row_id", made["rain_wet"].alias("rain_wet"), made["rain_heavy"].alias("rain_heavy"), r6(made["rain_log1p"], "rain_log1p"))


@query("O_P13_filter_range", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 100 AND 5000 THEN round(c_acctbal, 6) END AS acct FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL")
def _(t):
    return S.filter_not_negative(t.customer, ["c_acctbal"]).select("c_custkey", r6(S.null_out_of_range(F.col("c_acctbal"), 100, 5000), "acct"))


@query("O_P14_clip_lower", "SELECT c_custkey, round(greatest(c_acctbal, 0), 6) AS clipped, round(c_acctbal, 6) AS kept FROM customer")
def _(t):
    return t.customer.select("c_custkey", r6(S.clip_lower(F.col("c_acctbal")), "clipped"), r6(S.clip_lower(F.col("c_acctbal"), enabled=False), "kept"))


@query("O_P15_hour_ending_time", "SELECT k, d, h, CAST(d AS TIMESTAMP) + to_hours(h) AS t FROM hourly")
def _(t):
    from ..grain import hour_ending_time

    return t.hourly.select("k", "d", "h", hour_ending_time("d", "h").cast("timestamp_ntz").alias("t"))


@query("O_P16_quality_weight", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.75 END AS weight FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.quality_weight(F.col("o_orderstatus"), {"F": 1.0, "P": 0.5}, 0.75).alias("weight"))


@query("O_P17_entity_label", """SELECT c.c_custkey, coalesce(CAST(s.s_suppkey AS VARCHAR) || ' ' || replace(n.n_name, 'NATION_0', 'Home') || ', ' || CAST(n.n_regionkey AS VARCHAR), CAST(c.c_custkey AS VARCHAR)) AS label
    FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey LEFT JOIN (SELECT n_nationkey, CASE WHEN n_name = 'NATION_0' THEN 'Home' ELSE n_name END AS n_name, n_regionkey FROM nation) n ON s.s_nationkey = n.n_nationkey""")
def _(t):
    dim = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("c_custkey"), "n_name", F.col("n_regionkey").cast("string").alias("region"))
    return S.entity_label(t.customer.select("c_custkey"), dim, "c_custkey", "n_name", "region", {"NATION_0": "Home"}).select("c_custkey", "label")


def _wide(t):
    """Hourly counts by user and day as 24 columns; absent hours are NULL."""
    names = [F.sum(F.when(F.col("h") == i + 1, F.col("x"))).alias(c) for i, c in enumerate(reshape.HOURS)]
    return t.hourly.groupBy("k", "d").agg(*names)


@query("O_R1_unpivot_hours", "SELECT u.k, u.d, CAST(g.h AS INTEGER) AS hour_ending, h.x AS volume FROM (SELECT DISTINCT k, d FROM hourly) u CROSS JOIN (SELECT unnest(range(1, 25)) AS h) g LEFT JOIN hourly h ON h.k = u.k AND h.d = u.d AND h.h = g.h")
def _(t):
    return reshape.unpivot_hours(_wide(t), ["k", "d"]).select("k", "d", "hour_ending", "volume")


@query("O_R2_pivot_classes", """WITH e AS (SELECT user_id AS k, CAST(ts AS DATE) AS d, event_type AS c, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS v FROM events),
    g AS (SELECT k, d, c, coalesce(CAST(sum(v) AS DOUBLE), 0.0) AS v FROM e GROUP BY k, d, c)
    SELECT k, d, max(CASE WHEN c = 'click' THEN v END) AS clicks, max(CASE WHEN c = 'view' THEN v END) AS views, max(CASE WHEN c = 'error' THEN v END) AS errors FROM g GROUP BY k, d""")
def _(t):
    v = F.when(F.col("event_type") != "view", F.round(F.col("value") * 100).cast("long").cast("double"))
    rows = t.events.select(F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "event_type", v.alias("v"))
    return reshape.pivot_classes(rows, ["k", "d"], "event_type", "v", {"click": "clicks", "view": "views", "error": "errors"})


@query("O_R3_pivot_metrics", """SELECT model, stage, round(max(r2) FILTER (WHERE feature_set = 'all' AND split = 'train') - max(r2) FILTER (WHERE feature_set = 'all' AND split = 'validation'), 6) AS gap_tv,
    round(max(r2) FILTER (WHERE feature_set = 'all' AND split = 'validation') - max(r2) FILTER (WHERE feature_set = 'all' AND split = 'test'), 6) AS gap_vt, round(max(r2) FILTER (WHERE feature_set = 'exogenous' AND split = 'test'), 6) AS exo_test FROM results GROUP BY model, stage""")
def _(t):
    out = reshape.pivot_metrics(t.results, ["model", "stage"], ["all", "exogenous"], ["train", "validation", "test"], "r2")
    return out.select("model", "stage", r6(F.col("all_train_minus_validation"), "gap_tv"), r6(F.col("all_validation_minus_test"), "gap_vt"), r6(F.col("exogenous_test"), "exo_test"))


@query("O_R4_hold_control_columns", "SELECT k, round(avg(x) FILTER (WHERE flag = 0), 6) AS x_control, round(avg(x) FILTER (WHERE flag = 1), 6) AS x_event, round(avg(gappy) FILTER (WHERE flag = 0), 6) AS gappy_control, round(avg(gappy) FILTER (WHERE flag = 1), 6) AS gappy_event FROM daily GROUP BY k HAVING avg(x) FILTER (WHERE flag = 1) IS NOT NULL AND avg(x) FILTER (WHERE flag = 0) IS NOT NULL AND avg(gappy) FILTER (WHERE flag = 1) IS NOT NULL AND avg(gappy) FILTER (WHERE flag = 0) IS NOT NULL")
def _(t):
    out = reshape.hold_control_columns(t.daily, ["k"], F.col("flag"), ["x", "gappy"])
    return out.select("k", *[r6(F.col(c), c) for c in out.columns[1:]])


_SEQUENCES = """SELECT a.k, a.tick, CAST(sum(CASE WHEN b.k IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS available, round(sum(coalesce(b.x, 0) * (j.j + 1)), 6) AS weighted
    FROM daily a CROSS JOIN (SELECT unnest(range(0, 5)) AS j) j LEFT JOIN daily b ON b.k = a.k AND b.tick = a.tick - j.j GROUP BY a.k, a.tick"""


def _weighed(out):
    s = F.col("sequence")
    available = sum((s[i]["avail"] for i in range(5)), F.lit(0.0))
    weighted = sum((s[i]["x"][0] * (5 - i) for i in range(5)), F.lit(0.0))
    return out.select("k", "tick", available.alias("available"), r6(weighted, "weighted"))


@query("O_R5_sequence_windows", _SEQUENCES)
def _(t):
    return _weighed(reshape.sequence_windows(t.daily, "k", "tick", ["x"], 1, 5))


@query("O_R5_long_entities", _SEQUENCES)
def _(t):
    """The same windows, of slices of a year instead of whole entities."""
    return _weighed(scans.sequence_windows_of_slices(t.daily, ["k"], "tick", ["x"], 1, 5, 365))


@query("O_F9_drop_redundant", "SELECT row_id, k, x FROM daily")
def _(t):
    return features.drop_redundant(t.daily.select("row_id", "k", "x", "y", "wind"), ["y", "wind"])
