"""Queries of windows, order and selection (O-W, O-K), splits and features (O-F), and checks (O-V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import quality as V
from ..operators import scans as Sc
from ..operators import windows as Wn
from .q_scalars import r6
from .testbed import query


@query("O_W1_exact_lag", """SELECT a.k, a.tick, round(coalesce(b.y, 0), 6) AS lag1, CAST(b.k IS NOT NULL AS INTEGER) AS lag1_available, round(coalesce(c.y, 0), 6) AS lag7, CAST(c.k IS NOT NULL AS INTEGER) AS lag7_available
    FROM daily a LEFT JOIN daily b ON b.k = a.k AND b.tick = a.tick - 1 LEFT JOIN daily c ON c.k = a.k AND c.tick = a.tick - 7""")
def _(t):
    one, has1 = Wn.exact_lag("k", "tick", "y", 1)
    week, has7 = Wn.exact_lag("k", "tick", "y", 7)
    return t.daily.select("k", "tick", r6(one, "lag1"), has1.alias("lag1_available"), r6(week, "lag7"), has7.alias("lag7_available"))


@query("O_W2_lag_derivatives", """SELECT a.k, a.tick, CASE WHEN b.k IS NOT NULL THEN round(a.y - b.y, 6) ELSE 0.0 END AS change, CASE WHEN b.k IS NOT NULL AND b.y <> 0 THEN round(a.y / b.y, 6) ELSE 1.0 END AS ratio,
    CASE WHEN b.k IS NOT NULL AND c.k IS NOT NULL THEN round(b.y - c.y, 6) ELSE 0.0 END AS prior_change FROM daily a LEFT JOIN daily b ON b.k = a.k AND b.tick = a.tick - 1 LEFT JOIN daily c ON c.k = a.k AND c.tick = a.tick - 7""")
def _(t):
    made = Wn.lag_derivatives(F.col("y"), *Wn.exact_lag("k", "tick", "y", 1), *Wn.exact_lag("k", "tick", "y", 7))
    return t.daily.select("k", "tick", *[r6(c, n) for n, c in made.items()])


@query("O_W3_time_rolling", """WITH r AS (SELECT k, tick, count(gappy) OVER w AS c, avg(gappy) OVER w AS m, stddev_pop(gappy) OVER w AS s, sum(x) OVER w AS t FROM daily WINDOW w AS (PARTITION BY k ORDER BY tick RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING))
    SELECT k, tick, CASE WHEN c >= 3 THEN round(m, 6) ELSE 0.0 END AS mean14, CAST(c >= 3 AS INTEGER) AS mean14_available, CASE WHEN c >= 3 THEN round(s, 6) ELSE 0.0 END AS std14, CASE WHEN t IS NOT NULL THEN round(t, 6) ELSE 0.0 END AS sum14 FROM r""")
def _(t):
    mean, has = Wn.time_rolling("k", "tick", "gappy", 14, "mean", 3)
    return t.daily.select("k", "tick", r6(mean, "mean14"), has.alias("mean14_available"), r6(Wn.time_rolling("k", "tick", "gappy", 14, "std", 3)[0], "std14"), r6(Wn.time_rolling("k", "tick", "x", 14, "sum", 1)[0], "sum14"))


#: As many specs as a feature build has: means, deviations and sums over a week to a quarter.
_ROLLED = {f"{agg}{width}_{c}": (c, width, agg, least) for c, aggs in (("xs", ("mean", "std", "sum")), ("y", ("mean", "std")), ("gappy", ("mean", "std")), ("rain", ("mean", "sum"))) for agg in aggs for width, least in ((7, 2), (28, 7)) } | {f"mean91_{c}": (c, 91, "mean", 14) for c in ("xs", "y", "gappy", "wind")}
_ROLLED_SQL = {"mean": "avg({0}) OVER w{1}", "std": "stddev_pop({0}) OVER w{1}", "sum": "sum({0}) OVER w{1}"}


@query("O_W3_rolling_features", f"""SELECT k, tick, {", ".join(f"CASE WHEN count({c}) OVER w{w} >= {m} THEN round({_ROLLED_SQL[a].format(c, w)}, 4) ELSE 0.0 END AS {n}, CAST(count({c}) OVER w{w} >= {m} AS INTEGER) AS {n}_available" for n, (c, w, a, m) in _ROLLED.items())}
    FROM (SELECT *, x * 1.000123456789 AS xs FROM daily) d WINDOW {", ".join(f"w{w} AS (PARTITION BY k ORDER BY tick RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in (7, 28, 91))}""")
def _(t):
    rows = Wn.rolling_features(t.daily.select("k", "tick", "y", "gappy", "rain", "wind", (F.col("x") * 1.000123456789).alias("xs")), "k", "tick", _ROLLED)
    rounded = lambda n: (F.rint(F.col(n) * 10_000) / 10_000 + 0.0).alias(n)  # noqa: E731  # as DuckDB rounds, without a decimal each; no negative zeros
    return rows.select("k", "tick", *[r for n in _ROLLED for r in (rounded(n), F.col(f"{n}_available"))])


@query("O_W4_long_entities", """WITH r AS (SELECT 1 AS one, row_id, y, gappy, count(y) OVER w AS c, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s, last_value(gappy IGNORE NULLS) OVER (ORDER BY row_id) AS f FROM daily WINDOW w AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT row_id, round(m, 5) AS prior_mean, CASE WHEN c >= 2 THEN round(s, 4) END AS prior_std, CAST(c > 0 AS INTEGER) AS prior_available, round(coalesce(y - m, 0), 5) AS prior_difference, round(coalesce(f, 0), 5) AS filled FROM r""")
def _(t):
    """All rows as one entity, whose slices are as many tasks' work."""
    rows = t.daily.select(F.lit(1).alias("one"), "row_id", "y", "gappy")
    out = Sc.prior_expanding_of_slices(rows, ["one"], "row_id", "y", 100_000)
    out = Sc.forward_fill_of_slices(out, ["one"], "row_id", "gappy", 100_000, "filled")
    return out.select("row_id", F.round("prior_mean", 5).alias("prior_mean"), F.round("prior_std", 4).alias("prior_std"), "prior_available", F.round("prior_difference", 5).alias("prior_difference"), F.round("filled", 5).alias("filled"))


@query("O_W5_long_entities", """WITH r AS (SELECT row_id, x, avg(x) OVER (PARTITION BY slot ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM daily)
    SELECT row_id, round(coalesce(greatest(-3, least(3, ln(1 + x) - ln(1 + m))), 0), 5) AS surprise, CAST(m IS NOT NULL AS INTEGER) AS has_slot FROM r""")
def _(t):
    out = Sc.slot_surprise_of_slices(t.daily.select("slot", "row_id", "x"), ["slot"], "row_id", "x", 100_000)
    return out.select("row_id", F.round("surprise", 5).alias("surprise"), "has_slot")


@query("O_W4_prior_expanding", """WITH r AS (SELECT k, tick, y, count(y) OVER w AS c, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s FROM daily WINDOW w AS (PARTITION BY k ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT k, tick, round(m, 6) AS prior_mean, CASE WHEN c >= 2 THEN round(s, 5) END AS prior_std, CAST(c > 0 AS INTEGER) AS prior_available, round(coalesce(CASE WHEN m <> 0 THEN y / m END, 1), 6) AS prior_ratio, round(coalesce(y - m, 0), 6) AS prior_difference FROM r""")
def _(t):
    made = Wn.prior_expanding("k", "tick", "y")
    return t.daily.select("k", "tick", r6(made["prior_mean"], "prior_mean"), F.round(made["prior_std"], 5).alias("prior_std"), made["prior_available"].alias("prior_available"), r6(made["prior_ratio"], "prior_ratio"), r6(made["prior_difference"], "prior_difference"))


@query("O_W5_slot_surprise", """WITH r AS (SELECT k, tick, x, avg(x) OVER (PARTITION BY k, isodow(d) ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM daily)
    SELECT k, tick, round(coalesce(greatest(-0.5, least(0.5, ln(1 + x) - ln(1 + m))), 0), 6) AS surprise, CAST(m IS NOT NULL AS INTEGER) AS available FROM r""")
def _(t):
    s, has = Wn.slot_surprise("k", ["weekday"], "tick", "x", 0.5)
    return t.daily.withColumn("weekday", F.weekday("d")).select("k", "tick", r6(s, "surprise"), has.alias("available"))


@query("O_W6_forward_fill", "SELECT k, tick, round(coalesce(last_value(gappy IGNORE NULLS) OVER (PARTITION BY k ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS filled, CAST(gappy IS NOT NULL AS INTEGER) AS available FROM daily")
def _(t):
    filled, has = Wn.forward_fill("k", "tick", "gappy")
    return t.daily.select("k", "tick", r6(filled, "filled"), has.alias("available"))


@query("O_W7_row_rolling_mean", "SELECT k, tick, round(avg(x) OVER (PARTITION BY k ORDER BY tick ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean7 FROM daily")
def _(t):
    return t.daily.select("k", "tick", r6(Wn.row_rolling_mean("k", "tick", "x", 7), "mean7"))


@query("O_W8_equal_bins", """WITH r AS (SELECT row_id, row_number() OVER (PARTITION BY k ORDER BY x, row_id) AS r, count(*) OVER (PARTITION BY k) AS n FROM daily)
    SELECT row_id, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((r - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS bin FROM r""")
def _(t):
    return t.daily.select("row_id", Wn.equal_bins(["x", "row_id"], 5, ["k"]).alias("bin"))


@query("O_W8_equal_bins_of_all", """WITH r AS (SELECT row_id, row_number() OVER (ORDER BY x, row_id) AS r, count(*) OVER () AS n FROM daily)
    SELECT row_id, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((r - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS bin FROM r""")
def _(t):
    return Wn.equal_bins_of_all(t.daily.select("row_id", "x"), ["x", "row_id"], 5).select("row_id", "bin")


@query("O_W9_dedupe_keep", "SELECT k, row_id, round(x, 6) AS x FROM daily QUALIFY row_number() OVER (PARTITION BY k, kind ORDER BY tick DESC, row_id DESC) = 1")
def _(t):
    return Wn.dedupe_keep(t.daily, ["k", "kind"], ["tick", "row_id"], "last").select("k", "row_id", r6(F.col("x"), "x"))


@query("O_W10_rank_within", "SELECT row_id, CAST(rank() OVER (PARTITION BY k ORDER BY x DESC) AS INTEGER) AS place FROM daily")
def _(t):
    return t.daily.select("row_id", Wn.rank_within(["k"], "x").alias("place"))


@query("O_W11_prefix_fraction", "SELECT row_id FROM daily QUALIFY row_number() OVER (PARTITION BY k ORDER BY tick) <= greatest(1, ceil(count(*) OVER (PARTITION BY k) * 0.2))")
def _(t):
    return Wn.prefix_fraction(t.daily, "k", "tick", 0.2).select("row_id")


@query("O_K1_sort_panel", "SELECT row_id, round(x, 6) AS x FROM daily ORDER BY k, tick")
def _(t):
    return Wn.sort_panel(t.daily, "k", "tick").select("row_id", r6(F.col("x"), "x"))


@query("O_K2_top_k", "SELECT k, row_id, round(y, 6) AS y FROM daily QUALIFY row_number() OVER (PARTITION BY k ORDER BY y DESC, row_id) <= 3")
def _(t):
    return Wn.top_k(t.daily, "y", 3, "row_id", ["k"]).select("k", "row_id", r6(F.col("y"), "y"))


@query("O_K3_top_models", """WITH b AS (SELECT * FROM results WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY model ORDER BY CASE WHEN stage = 'tuned' THEN 0 ELSE 1 END) = 1),
    p AS (SELECT *, row_number() OVER (ORDER BY r2 DESC NULLS LAST, model) AS place FROM b) SELECT model, stage, CAST(place AS INTEGER) AS place FROM p WHERE place <= 2 OR model = 'B2'""")
def _(t):
    return Wn.top_models(t.results.filter("split = 'test'"), 2, "B2").select("model", "stage", "place")


@query("O_K4_pick_cases", """WITH m AS (SELECT quantile_cont(y, 0.5) AS med FROM daily), q AS (SELECT quantile_cont(wind, 1.0/3) AS lo, quantile_cont(wind, 2.0/3) AS hi FROM daily WHERE kind = 1),
    c AS (SELECT quantile_cont(CASE WHEN wind <= lo THEN y END, 0.5) AS calm, quantile_cont(CASE WHEN wind >= hi THEN y END, 0.5) AS windy FROM daily, q WHERE kind = 1)
    SELECT 'highest' AS "case", (SELECT row_id FROM daily ORDER BY y DESC, row_id LIMIT 1) AS "row" UNION ALL SELECT 'typical', (SELECT row_id FROM daily, m ORDER BY abs(y - med), row_id LIMIT 1)
    UNION ALL SELECT 'calm', (SELECT row_id FROM daily, q, c WHERE kind = 1 AND wind <= lo ORDER BY abs(y - calm), row_id LIMIT 1) UNION ALL SELECT 'windy', (SELECT row_id FROM daily, q, c WHERE kind = 1 AND wind >= hi ORDER BY abs(y - windy), row_id LIMIT 1)""")
def _(t):
    return Wn.pick_cases(t.daily, "row_id", "y", "wind", F.col("kind") == 1)


@query("O_K5_sample_rows", "SELECT row_id, round(x, 6) AS x FROM daily ORDER BY CAST('0x' || substr(md5('5:' || row_id), 1, 15) AS BIGINT), row_id LIMIT 500")
def _(t):
    return Wn.sample_rows(t.daily, "row_id", 500, 5).select("row_id", r6(F.col("x"), "x"))


@query("O_K6_set_compare", """SELECT k, 'left' AS side FROM (SELECT DISTINCT l_partkey % 997 AS k FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT o_custkey % 997 FROM orders WHERE o_orderstatus = 'P') a
    UNION ALL SELECT k, 'right' FROM (SELECT o_custkey % 997 AS k FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT l_partkey % 997 FROM lineitem WHERE l_quantity > 48) b""")
def _(t):
    a = t.lineitem.filter("l_quantity > 48").select((F.col("l_partkey") % 997).alias("k"))
    return Wn.set_compare(a, t.orders.filter("o_orderstatus = 'P'").select((F.col("o_custkey") % 997).alias("k")))


_CUTS = "SELECT CAST(to_timestamp(floor(quantile_cont(tick * 86400, 0.7))) AT TIME ZONE 'UTC' AS DATE) AS cut_validation, CAST(to_timestamp(floor(quantile_cont(tick * 86400, 0.85))) AT TIME ZONE 'UTC' AS DATE) AS cut_test FROM daily"


@query("O_F1_split_cutoffs", _CUTS)
def _(t):
    return X.split_cutoffs(t.daily, "d")


@query("O_F2_chrono_split", f"WITH c AS ({_CUTS}) SELECT row_id, CASE WHEN d < cut_validation THEN 'train' WHEN d < cut_test THEN 'validation' ELSE 'test' END AS split FROM daily, c")
def _(t):
    return X.chrono_split(t.daily, "d").select("row_id", "split")


@query("O_F3_impute_train_median", "WITH m AS (SELECT quantile_cont(gappy, 0.5) AS m FROM marked WHERE split = 'train') SELECT row_id, round(coalesce(gappy, m), 6) AS gappy, CAST(gappy IS NOT NULL AS INTEGER) AS gappy_available FROM marked, m")
def _(t):
    return X.impute_train_median(t.marked, ["gappy"]).select("row_id", r6(F.col("gappy"), "gappy"), "gappy_available")


@query("O_F4_drop_constant", "SELECT 'x' AS \"column\", count(DISTINCT x) <= 1 AS is_constant FROM daily UNION ALL SELECT 'one', count(DISTINCT n * 0) <= 1 FROM daily UNION ALL SELECT 'nothing', true FROM (SELECT count(*) FROM daily) c UNION ALL SELECT 'gappy', count(DISTINCT gappy) <= 1 AND count(gappy) IN (0, count(*)) FROM daily")
def _(t):
    return X.constant_columns(t.daily.withColumns({"one": F.col("n") * 0, "nothing": F.lit(None).cast("double")}), ["x", "one", "nothing", "gappy"])


@query("O_F5_binary_columns", "SELECT 'flag' AS \"column\", bool_and(flag IN (0, 1)) AS is_binary FROM daily UNION ALL SELECT 'x', bool_and(round(x, 6) IN (0, 1)) FROM daily UNION ALL SELECT 'kind', bool_and(kind IN (0, 1)) FROM daily")
def _(t):
    return X.binary_columns(t.daily, ["flag", "x", "kind"])


@query("O_F6_standardise", "WITH s AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM marked WHERE split = 'train') SELECT row_id, round((x - m) / s, 6) AS x, round(x, 6) AS back FROM marked, s")
def _(t):
    fitted = X.scaler(t.marked, ["x"])
    scaled = X.standardise(t.marked, fitted, ["x"])
    back = X.unscale(scaled.select("row_id", "x"), fitted, ["x"]).withColumnRenamed("x", "back")
    return scaled.join(back, "row_id").select("row_id", r6(F.col("x"), "x"), r6(F.col("back"), "back"))


@query("O_F7_prune_correlated", """WITH c AS (SELECT corr(x, x * 2 + wind * 0.001) AS a, corr(x, y) AS b, corr(x, wind) AS e, corr(y, wind) AS f FROM marked WHERE split = 'train')
    SELECT 'x' AS feature, 1 AS kept, '' AS reason FROM c UNION ALL SELECT 'lag_x', CAST(abs(a) <= 0.95 AS INTEGER), CASE WHEN abs(a) > 0.95 THEN 'correlated with x' ELSE '' END FROM c
    UNION ALL SELECT 'y', CAST(abs(b) <= 0.95 AS INTEGER), CASE WHEN abs(b) > 0.95 THEN 'correlated with x' ELSE '' END FROM c UNION ALL SELECT 'wind', CAST(abs(e) <= 0.95 AND abs(f) <= 0.95 AS INTEGER), '' FROM c UNION ALL SELECT 'one', 0, 'constant' FROM c""")
def _(t):
    rows = t.marked.withColumns({"lag_x": F.col("x") * 2 + F.col("wind") * 0.001, "one": F.lit(1)})
    return X.prune_correlated(rows, ["lag_x", "x", "y", "wind", "one"])


@query("O_F7_prune_sets", """WITH c AS (SELECT corr(x, y) AS b, corr(x, wind) AS e, corr(y, wind) AS f, corr(x * 2 + wind * 0.001, x + wind * 0.002) AS g FROM marked WHERE split = 'train')
    SELECT 'exogenous' AS "set", 'x' AS feature, 1 AS kept, '' AS reason FROM c UNION ALL SELECT 'exogenous', 'y', CAST(abs(b) <= 0.95 AS INTEGER), CASE WHEN abs(b) > 0.95 THEN 'correlated with x' ELSE '' END FROM c
    UNION ALL SELECT 'exogenous', 'wind', CAST(abs(e) <= 0.95 AND abs(f) <= 0.95 AS INTEGER), '' FROM c UNION ALL SELECT 'autoregressive', 'lag_x', 1, '' FROM c
    UNION ALL SELECT 'autoregressive', 'lag_w', CAST(abs(g) <= 0.95 AS INTEGER), CASE WHEN abs(g) > 0.95 THEN 'correlated with lag_x' ELSE '' END FROM c UNION ALL SELECT 'autoregressive', 'one', 0, 'constant' FROM c""")
def _(t):
    rows = t.marked.withColumns({"lag_x": F.col("x") * 2 + F.col("wind") * 0.001, "lag_w": F.col("x") + F.col("wind") * 0.002, "one": F.lit(1)})
    return X.prune_sets(rows, {"exogenous": ["x", "y", "wind"], "autoregressive": ["lag_x", "lag_w", "one"]})


@query("O_F8_feature_roles", """SELECT r.feature, r.role, count(*) AS n FROM (VALUES ('k', 'metadata'), ('tick', 'trend'), ('x', 'exogenous'), ('y', 'target'), ('wind', 'exogenous'), ('n', 'weight'), ('lag_y', 'autoregressive')) AS r(feature, role) CROSS JOIN daily GROUP BY r.feature, r.role""")
def _(t):
    rows = t.daily.select("k", "tick", "x", "y", "wind", "n", F.lit(0.0).alias("lag_y"))
    roles = X.feature_roles(rows, "y", "n", ["k"], ["tick"], ["lag_", "roll_"])
    return roles.join(F.broadcast(rows.agg(F.count("*").alias("n")))).select("feature", "role", "n")


@query("O_V1_check_unique", "SELECT 'repeated_key' AS \"check\", count(*) AS violations FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) u")
def _(t):
    return V.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("O_V2_check_source", """SELECT 'null_target' AS "check", CAST(count_if(gappy IS NULL) AS BIGINT) AS violations FROM daily UNION ALL SELECT 'negative_driver', CAST(count_if(x < 0 OR wind - 2 < 0) AS BIGINT) FROM daily UNION ALL SELECT 'total_off', CAST(count_if(abs(x - (x - wind) - wind) > 1e-8) AS BIGINT) FROM daily UNION ALL SELECT 'hour_range', CAST(count_if(n NOT BETWEEN 1 AND 24) AS BIGINT) FROM daily""")
def _(t):
    rows = t.daily.withColumns({"light": F.col("x") - F.col("wind"), "low": F.col("wind") - 2})
    return V.check_source(rows, "gappy", ["x", "low"], "x", ["light", "wind"], "n")


@query("O_V3_check_output", """SELECT 'null' AS "check", CAST(count_if(gappy IS NULL) AS BIGINT) AS violations FROM daily UNION ALL SELECT 'infinite', 0 FROM (SELECT count(*) FROM daily) c UNION ALL SELECT 'share_range', CAST(count_if(wind / 8 > 1 OR wind < 0) AS BIGINT) FROM daily UNION ALL SELECT 'one_hot_kind', CAST(count_if(kind = 3) AS BIGINT) FROM daily UNION ALL SELECT 'one_hot_flag', 0 FROM (SELECT count(*) FROM daily) c""")
def _(t):
    rows = t.daily.withColumns({"k0": (F.col("kind") == 0).cast("int"), "k1": (F.col("kind") == 1).cast("int"), "k2": (F.col("kind") == 2).cast("int"), "share": F.col("wind") / 8})
    return V.check_output(rows, ["x", "gappy"], {"kind": (["k0", "k1", "k2"], False), "flag": (["flag"], True)}, ["share"])


@query("O_V4_check_lag_leakage", "SELECT 'lag_not_past_target' AS \"check\", CAST(count_if(a.tick % 100 = 0 AND b.k IS NOT NULL) AS BIGINT) AS violations FROM daily a LEFT JOIN daily b ON b.k = a.k AND b.tick = a.tick - 1")
def _(t):
    lag, has = Wn.exact_lag("k", "tick", "y", 1)
    rows = t.daily.withColumns({"lag": lag, "has": has}).withColumn("lag", F.when(F.col("tick") % 100 == 0, F.col("lag") + 1).otherwise(F.col("lag")))
    return V.check_lag_leakage(rows, "k", "tick", "y", "lag", "has", 1)


@query("O_V5_check_reconcile", """WITH a AS (SELECT k, sum(x) AS v FROM daily GROUP BY k), b AS (SELECT l_suppkey AS k, sum(CAST(l_quantity AS BIGINT)) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_suppkey % 17 <> 0 GROUP BY l_suppkey)
    SELECT 'one_side' AS "check", CAST(count_if(a.k IS NULL OR b.k IS NULL) AS BIGINT) AS violations FROM a FULL JOIN b ON a.k = b.k UNION ALL SELECT 'different', CAST(count_if(abs(a.v - b.v) > 1e-8) AS BIGINT) FROM a FULL JOIN b ON a.k = b.k""")
def _(t):
    a = t.daily.groupBy("k").agg(F.sum("x").alias("v"))
    b = t.lineitem.filter("l_suppkey % 17 <> 0").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return V.check_reconcile(a, b.withColumn("v", F.col("v") + F.when(F.col("k") % 10 == 0, 1).otherwise(0)), ["k"], "v")
