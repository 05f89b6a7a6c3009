"""How well does persistence predict each entity on the test period? The first query, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines, evaluate, features, windows
from ..operators.quality import check_unique, require
from ..shipping import saved
from .q_joins import _rounded
from .testbed import Testbed, query

HOUR = 3600


def hourly_features(panel: DataFrame) -> DataFrame:
    """Lags of 1 and 24 hours and the mean of the day before, over one sort of each entity."""
    lag1, has1 = windows.exact_lag("k", "tick", "y", HOUR)
    lag24, has24 = windows.exact_lag("k", "tick", "y", 24 * HOUR)
    mean24, has_mean = windows.time_rolling("k", "tick", "y", 24 * HOUR, "mean", 1)
    return panel.withColumns({"lag1": lag1, "lag1_available": has1, "lag24": lag24, "lag24_available": has24, "mean24": mean24, "mean24_available": has_mean})


@query("flagship_persistence_by_entity", """WITH c AS (SELECT CAST(floor(quantile_cont(tick, 0.7) / 86400) AS BIGINT) * 86400 AS a, CAST(floor(quantile_cont(tick, 0.85) / 86400) AS BIGINT) * 86400 AS b FROM hourly),
    m AS (SELECT h.*, CASE WHEN tick < a THEN 'train' WHEN tick < b THEN 'validation' ELSE 'test' END AS split FROM hourly h, c), e AS (SELECT k, avg(y) AS v FROM m WHERE split = 'train' GROUP BY k), g AS (SELECT avg(y) AS v FROM m WHERE split = 'train'),
    f AS (SELECT k, tick, avg(y) OVER (PARTITION BY k ORDER BY tick RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS m24 FROM m),
    p AS (SELECT m.k, m.y, coalesce(l.y, e.v, g.v) AS q, f.m24, l.k IS NOT NULL AS has FROM m LEFT JOIN hourly l ON l.k = m.k AND l.tick = m.tick - 3600 LEFT JOIN e ON e.k = m.k JOIN f ON f.k = m.k AND f.tick = m.tick, g WHERE m.split = 'test')
    SELECT k, count(*) AS n, round(sqrt(avg(pow(y - q, 2))), 4) AS rmse, round(avg(abs(y - q)), 4) AS mae, CAST(count_if(has) AS BIGINT) AS with_lag, round(avg(coalesce(m24, 0)), 4) AS mean_day_before FROM p GROUP BY k""")
def flagship(t: Testbed) -> DataFrame:
    panel = saved(t.hourly, "hourly")
    require(check_unique(panel, ["k", "tick"]))
    panel = features.chrono_split(panel.withColumn("t", F.timestamp_seconds("tick")), "t")
    rows = hourly_features(panel)
    scored = baselines.persistence_baseline(rows, "k", "tick", "y", HOUR).filter("split = 'test'")
    extra = scored.groupBy("k").agg(F.sum("lag1_available").alias("with_lag"), F.avg("mean24").alias("mean_day_before"))
    out = evaluate.evaluate(scored.withColumnRenamed("y", "y_true"), ["k"]).join(extra, "k")
    return _rounded(out.select("k", "n", "rmse", "mae", "with_lag", "mean_day_before"), [], 4)
