"""Panels over the given tables, as SQL text that Spark and DuckDB both run, and the registry of queries.

daily:   l_suppkey as entity, l_shipdate as day; quantity, price, discount and tax as readings.
hourly:  events by user and hour. Sums are of integers, so that both engines get equal doubles; odd
factors keep results off the ties of rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import dealt_if_large

SPARK = {"days": "CAST(unix_date({}) AS BIGINT)", "pmod": "pmod({}, {})"}
DUCK = {"days": "CAST({} - DATE '1970-01-01' AS BIGINT)", "pmod": "((({0}) % ({1}) + ({1})) % ({1}))"}

VIEWS = {
    "daily": """
        SELECT k, d, [days:d] AS tick, x, y, wind, rain, n,
               CASE WHEN (k * 31 + [days:d]) % 11 = 0 THEN NULL ELSE wind END AS gappy,
               CAST((k * 31 + [days:d]) % 7 = 0 AS INTEGER) AS flag, k % 5 AS slot, CAST(k % 4 AS INTEGER) AS kind,
               k * 100000 + [days:d] AS row_id
        FROM (
          SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d,
                 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS x,
                 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 98765.4321 AS y,
                 CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 1.000123456789 / count(*) AS wind,
                 CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 1.000123456789 / count(*) AS rain,
                 CAST(count(*) AS BIGINT) AS n
          FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
        ) AS base
    """,
    "hourly": """
        SELECT k, d, h, [days:d] * 86400 + h * 3600 AS tick, x, y, [days:d] AS day
        FROM (
          SELECT user_id AS k, CAST(ts AS DATE) AS d, CAST(hour(ts) + 1 AS INTEGER) AS h, CAST(count(*) AS DOUBLE) AS x,
                 CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 98.7654321 AS y
          FROM events GROUP BY user_id, CAST(ts AS DATE), hour(ts) + 1
        ) AS base
    """,
    "marked": """
        SELECT *, CASE WHEN d < DATE '1999-06-01' THEN 'train' WHEN d < DATE '2000-06-01' THEN 'validation' ELSE 'test' END AS split FROM daily
    """,
    "preds": """
        SELECT m.model, m.stage, 'daily' AS grain, m.feature_set, p.split, p.k, p.d, p.tick, p.row_id, p.kind, p.flag, p.y AS y_true,
               CASE WHEN m.model = 'B1' THEN coalesce(p.prev, 40.0) WHEN m.model = 'B2' THEN 40.0 + p.slot ELSE p.x * m.f END AS y_pred
        FROM (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY d) AS prev FROM marked) AS p
        CROSS JOIN (SELECT * FROM (VALUES ('B1', 'default', 'all', 1.0), ('B2', 'default', 'all', 1.0), ('M1', 'default', 'all', 1.2), ('M1', 'tuned', 'all', 1.5),
                                          ('M2', 'default', 'exogenous', 1.4), ('M2', 'tuned', 'exogenous', 1.45)) AS v(model, stage, feature_set, f)) AS m
    """,
    "results": """
        SELECT model, stage, grain, feature_set, split, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) AS mae,
               1 - sum((y_true - y_pred) * (y_true - y_pred)) / (sum(y_true * y_true) - sum(y_true) * sum(y_true) / count(*)) AS r2,
               CAST(count(*) AS DOUBLE) / 1000 + length(stage) AS train_seconds
        FROM preds GROUP BY model, stage, grain, feature_set, split
    """,
    "places": "SELECT s_suppkey AS id, -38 + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 100 AS lat, 140 + CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 100 AS lon, s_nationkey FROM supplier",
    "sites": "SELECT n_name AS site, -38 + CAST(n_nationkey * 411 % 1000 AS DOUBLE) / 100 AS lat, 140 + CAST(n_nationkey * 277 % 1000 AS DOUBLE) / 100 AS lon FROM nation",
    "holidays": "SELECT * FROM (VALUES (DATE '1996-01-01'), (DATE '1996-12-25'), (DATE '1997-07-04'), (DATE '1998-03-15'), (DATE '1999-11-11'), (DATE '2000-05-05')) AS v(date)",
    "dim": "SELECT s_suppkey AS k, s_name AS road, n_name AS place, s_nationkey AS nation, s_acctbal AS acct FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "phi": """
        SELECT row_id, kind, feature, value, phi FROM (
          SELECT row_id, kind, 'x' AS feature, x AS value, 1.5 * (x - mx) AS phi FROM daily CROSS JOIN (SELECT avg(x) AS mx FROM daily) AS a
          UNION ALL SELECT row_id, kind, 'wind', wind, -0.25 * (wind - mw) FROM daily CROSS JOIN (SELECT avg(wind) AS mw FROM daily) AS b
          UNION ALL SELECT row_id, kind, 'rain', rain, 0.5 * (rain - mr) FROM daily CROSS JOIN (SELECT avg(rain) AS mr FROM daily) AS c
        ) AS u
    """,
}
#: Of views that group a table into about as many rows as it has: the table, and what they group by.
GROUPED = {"daily": ("lineitem", ("l_suppkey", "CAST(l_shipdate AS DATE)")), "hourly": ("events", ("user_id", "CAST(ts AS DATE)", "hour(ts) + 1"))}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _render(text: str, dialect: dict[str, str]) -> str:
    out = text
    while (at := out.find("[days:")) >= 0:
        end = out.index("]", at)
        out = out[:at] + dialect["days"].format(out[at + 6 : end]) + out[end + 1 :]
    return out


class Testbed:
    """Tables of a folder and the views above as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = _render(VIEWS[name], SPARK)
                used = {v: getattr(self, v) for v in (*VIEWS, *TABLES) if v != name and _mentions(text, v)}
                if name in GROUPED:
                    table, keys = GROUPED[name]
                    used[table] = dealt_if_large(used[table], *map(F.expr, keys))
                for v in used:
                    text = _replace(text, v)
                self._made[name] = self.spark.sql(text, **used)
        return self._made[name]


def _mentions(text: str, view: str) -> bool:
    return any(f"{w} {view}{e}" in text + " " for w in ("FROM", "JOIN") for e in (" ", "\n", ")"))


def _replace(text: str, view: str) -> str:
    for w in ("FROM", "JOIN"):
        for e in (" ", "\n", ")"):
            text = (text + " ").replace(f"{w} {view}{e}", f"{w} {{{view}}}{e}")[: None if text.endswith(" ") else -1] if f"{w} {view}{e}" in text + " " else text
    return text


def duck_sql(query: str) -> str:
    """DuckDB SQL with the views that the query needs in front of it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if v not in needed and _mentions(text, v):
                add(VIEWS[v])
                if v not in needed:
                    needed.append(v)

    add(query)
    body = _render(query, DUCK).strip()
    if not needed:
        return body
    views = ", ".join(f"{v} AS ({_render(VIEWS[v], DUCK)})" for v in needed)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"WITH {views} {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a testbed under the operator's ID, with the SQL that must agree."""

    def add(f: Callable[[Testbed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Testbed(spark, sf_dir))
        if sql:
            ORACLES[name] = duck_sql(sql)
        return f

    return add
