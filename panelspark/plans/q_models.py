"""Queries of baselines and models (O-B, O-M), evaluation (O-E), explanation (O-X) and events (O-H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as B
from ..operators import evaluate as E
from ..operators import events as H
from ..operators import explain as X
from ..operators import gram as G
from ..operators import models as M
from ..operators import reshape
from ..operators.joins import nearest_event_window
from ..operators.windows import pick_cases
from .q_joins import _rounded
from .q_scalars import r6
from .testbed import query

#: A fixed linear model for queries of what is made from models.
LINEAR = G.Linear(("x", "wind", "rain"), (2.0, 1.5, -0.25, 0.5))


@query("O_B1_persistence_baseline", """WITH e AS (SELECT k, avg(y) AS m FROM marked WHERE split = 'train' GROUP BY k), a AS (SELECT avg(y) AS m FROM marked WHERE split = 'train')
    SELECT d.row_id, round(coalesce(p.y, e.m, a.m), 5) AS y_pred FROM marked d LEFT JOIN daily p ON p.k = d.k AND p.tick = d.tick - 1 LEFT JOIN e ON e.k = d.k, a""")
def _(t):
    return B.persistence_baseline(t.marked, "k", "tick", "y", 1).select("row_id", F.round("y_pred", 5).alias("y_pred"))


@query("O_B2_seasonal_climatology", """WITH c AS (SELECT k, month(d) AS m, avg(y) AS v FROM marked WHERE split = 'train' GROUP BY k, month(d)), e AS (SELECT k, avg(y) AS v FROM marked WHERE split = 'train' GROUP BY k), a AS (SELECT avg(y) AS v FROM marked WHERE split = 'train')
    SELECT d.row_id, round(coalesce(c.v, e.v, a.v), 5) AS y_pred FROM marked d LEFT JOIN c ON c.k = d.k AND c.m = month(d.d) LEFT JOIN e ON e.k = d.k, a""")
def _(t):
    return B.seasonal_climatology(t.marked.withColumn("m", F.month("d")), "k", ["m"], "y").select("row_id", F.round("y_pred", 5).alias("y_pred"))


@query("O_B3_network_mean", "WITH s AS (SELECT k, sum(x * y) AS s, sum(x) AS w FROM daily GROUP BY k), t AS (SELECT sum(s) AS s, sum(w) AS w FROM s) SELECT k, round((t.s - s.s) / (t.w - s.w), 5) AS y_pred FROM s, t")
def _(t):
    return _rounded(B.network_mean(t.daily, "k", "y", "x"), [], 5)


def _ridge_sql(sums: str, alpha: str) -> str:
    """Coefficients of y on x and wind from sums n, sx, sz, sy, sxx, sxz, szz, sxy, szy of a table expression."""
    return f"""SELECT *, b0 + 0 AS b FROM (SELECT *, sy / n - bx * sx / n - bz * sz / n AS b0 FROM (SELECT *, (xy * (zz + {alpha}) - zy * xz) / ((xx + {alpha}) * (zz + {alpha}) - xz * xz) AS bx, (zy * (xx + {alpha}) - xy * xz) / ((xx + {alpha}) * (zz + {alpha}) - xz * xz) AS bz
        FROM (SELECT *, sxx - sx * sx / n AS xx, szz - sz * sz / n AS zz, sxz - sx * sz / n AS xz, sxy - sx * sy / n AS xy, szy - sz * sy / n AS zy FROM {sums}) q) q2) q3"""


_SUMS = "count(*) AS n, sum(x) AS sx, sum(wind) AS sz, sum(y) AS sy, sum(x * x) AS sxx, sum(x * wind) AS sxz, sum(wind * wind) AS szz, sum(x * y) AS sxy, sum(wind * y) AS szy, sum(y * y) AS syy"


@query("O_M1_ridge_fit_predict", f"WITH s AS (SELECT {_SUMS} FROM marked WHERE split = 'train'), r AS ({_ridge_sql('s', '100')}) SELECT row_id, round(b0 + bx * x + bz * wind, 5) AS y_pred FROM marked, r")
def _(t):
    model = G.ridge_fit(t.marked.filter("split = 'train'"), ["x", "wind"], "y", 100.0)
    return model.transform(t.marked).select("row_id", F.round("y_pred", 5).alias("y_pred"))


@query("O_M2_tree_and_forest")
def _(t):
    rows = t.marked
    train = rows.filter("split = 'train'")
    tree = M.tree_fit(train, ["x", "wind", "rain"], "y", "n").transform(rows)
    forest = M.forest_fit(train, ["x", "wind", "rain"], "y", "n").transform(rows)
    both = tree.withColumn("model", F.lit("tree")).unionByName(forest.withColumn("model", F.lit("forest")))
    return E.evaluate(both.withColumnRenamed("y", "y_true"), ["model", "split"])


@query("O_M3_gbt_fit")
def _(t):
    rows = t.marked.withColumn("held", F.col("split") == "validation")
    fitted = M.gbt_fit(rows.filter("split <> 'test'"), ["x", "wind", "rain"], "y", None, "held", rounds=10)
    return E.evaluate(fitted.transform(rows).withColumnRenamed("y", "y_true"), ["split"])


_LEVELS = ("kind", "flag", "slot")


def _split_sql(name: str, source: str, target: str) -> str:
    """Table expressions ending in <name>_b (f, v, ml, mr): the column and value of the best first split of target,
    and the means on its sides. The columns have few values, so that a tree tries every place between them."""
    values = " UNION ALL ".join(f"SELECT '{c}' AS f, CAST({c} AS DOUBLE) AS v, {target} AS t FROM {source}" for c in _LEVELS)
    return f"""{name}_c AS (SELECT f, v, count(*) AS n, sum(t) AS s FROM ({values}) u GROUP BY f, v),
    {name}_w AS (SELECT f, v, sum(n) OVER (PARTITION BY f ORDER BY v) AS nl, sum(s) OVER (PARTITION BY f ORDER BY v) AS sl, sum(n) OVER (PARTITION BY f) AS nn, sum(s) OVER (PARTITION BY f) AS ss FROM {name}_c),
    {name}_b AS (SELECT f, v, sl / nl AS ml, (ss - sl) / (nn - nl) AS mr FROM {name}_w WHERE nl < nn ORDER BY sl * sl / nl + (ss - sl) * (ss - sl) / (nn - nl) DESC LIMIT 1)"""


_SIDE = "CASE WHEN CASE f WHEN 'kind' THEN kind WHEN 'flag' THEN flag ELSE slot END <= v THEN ml ELSE mr END"
_TREE_SCORES = "count(*) AS n, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum(pow(y - p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 4) AS r2"


@query("O_M2_one_split", f"WITH tr AS (SELECT kind, flag, slot, y FROM marked WHERE split = 'train'), {_split_sql('one', 'tr', 'y')}, e AS (SELECT split, y, {_SIDE} AS p FROM marked, one_b) SELECT split, {_TREE_SCORES} FROM e GROUP BY split")
def _(t):
    fitted = M.tree_fit(t.marked.filter("split = 'train'"), _LEVELS, "y", depth=1)
    return _rounded(E.evaluate(fitted.transform(t.marked).withColumnRenamed("y", "y_true"), ["split"]), [], 4)


@query("O_M3_two_rounds", f"""WITH tr AS (SELECT kind, flag, slot, y FROM marked WHERE split = 'train'), {_split_sql('one', 'tr', 'y')}, res AS (SELECT kind, flag, slot, 2 * (y - {_SIDE}) AS z FROM tr, one_b), {_split_sql('two', 'res', 'z')},
    f AS (SELECT split, kind, flag, slot, y, {_SIDE} AS p1 FROM marked, one_b), e AS (SELECT split, y, p1 + 0.1 * {_SIDE} AS p FROM f, two_b) SELECT split, {_TREE_SCORES} FROM e GROUP BY split""")
def _(t):
    fitted = M.gbt_fit(t.marked.filter("split = 'train'"), _LEVELS, "y", rounds=2, depth=1, sample=1.0, columns="all")
    return _rounded(E.evaluate(fitted.transform(t.marked).withColumnRenamed("y", "y_true"), ["split"]), [], 4)


#: Ridge on windows of two steps of x: the earlier step's availability and value, the own value; the own availability
#: is constant and has no part.
_WINDOW_FIT = """f AS (SELECT m.row_id, m.split, m.y, CASE WHEN p.k IS NULL THEN 0.0 ELSE 1.0 END AS a, coalesce(p.x, 0.0) AS b, m.x AS c FROM marked m LEFT JOIN daily p ON p.k = m.k AND p.tick = m.tick - 1),
    s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, regr_sxx(a, a) + 10 AS aa, regr_sxy(a, b) AS ab, regr_sxy(a, c) AS ac, regr_sxx(b, b) + 10 AS bb, regr_sxy(b, c) AS bc, regr_sxx(c, c) + 10 AS cc, regr_sxy(a, y) AS ra, regr_sxy(b, y) AS rb, regr_sxy(c, y) AS rc FROM f WHERE split = 'train'),
    d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
    g AS (SELECT *, (ra * (bb * cc - bc * bc) - ab * (rb * cc - bc * rc) + ac * (rb * bc - bb * rc)) / det AS ba, (aa * (rb * cc - rc * bc) - ra * (ab * cc - bc * ac) + ac * (ab * rc - rb * ac)) / det AS bb2, (aa * (bb * rc - bc * rb) - ab * (ab * rc - rb * ac) + ra * (ab * bc - bb * ac)) / det AS bc2 FROM d),
    h AS (SELECT ba, bb2, bc2, my - ba * ma - bb2 * mb - bc2 * mc AS b0 FROM g)"""


def _two_steps(t):
    rows = reshape.sequence_windows(t.marked, "k", "tick", ["x"], 1, 2)
    return M.window_ridge(rows, ["x"], "y", 2, 10.0, F.col("split") == "train")


@query("O_M4_two_steps", f"WITH {_WINDOW_FIT}, e AS (SELECT split, y, b0 + ba * a + bb2 * b + bc2 * c AS p FROM f, h) SELECT split, {_TREE_SCORES} FROM e GROUP BY split")
def _(t):
    model, flat = _two_steps(t)
    return _rounded(E.evaluate(model.transform(flat).withColumnRenamed("y", "y_true"), ["split"]), [], 4)


@query("O_M4_window_ridge")
def _(t):
    rows = reshape.sequence_windows(t.marked, "k", "tick", ["x", "y"], 1, 3)
    model, flat = M.window_ridge(rows.withColumn("target", F.col("wind") + F.col("x")), ["x", "y"], "target", 3, 10.0, F.col("split") == "train")
    return E.evaluate(model.transform(flat).withColumn("y_true", F.col("target")), ["split"])


@query("O_M5_search", f"""WITH s AS (SELECT {_SUMS} FROM marked WHERE split = 'train'), al AS (SELECT unnest([0.5, 100.0, 10000.0]) AS alpha), sa AS (SELECT s.*, alpha FROM s, al), r AS ({_ridge_sql('sa', 'alpha')}),
    e AS (SELECT alpha, split, sqrt(avg(pow(y - b0 - bx * x - bz * wind, 2))) AS rmse FROM marked, r GROUP BY alpha, split), w AS (SELECT alpha, max(rmse) FILTER (WHERE split = 'train') AS a, max(rmse) FILTER (WHERE split = 'validation') AS v, max(rmse) FILTER (WHERE split = 'test') AS z FROM e GROUP BY alpha)
    SELECT CAST(alpha AS DOUBLE) AS alpha, round(a, 5) AS rmse_train, round(v, 5) AS rmse_validation, CASE WHEN v = (SELECT min(v) FROM w) THEN round(z, 5) END AS rmse_test, v = (SELECT min(v) FROM w) AS best FROM w""")
def _(t):
    return _rounded(G.search_alpha(t.marked, ["x", "wind"], "y", [0.5, 100.0, 10000.0]), [], 5)


_TRIED = M.candidates({"alpha": [0.5, 30.0, 100.0, 3000.0, 10000.0]}, [{"alpha": 10.0}], 5, 7)
_TRIALS = ", ".join(f"({i}, CAST({c['alpha']} AS DOUBLE))" for i, c in enumerate(_TRIED))


@query("O_M5_search_candidates", f"""WITH s AS (SELECT {_SUMS} FROM marked WHERE split = 'train'), al AS (SELECT * FROM (VALUES {_TRIALS}) AS v(trial, alpha)), sa AS (SELECT s.*, alpha FROM s, al), r AS ({_ridge_sql('sa', 'alpha')}),
    e AS (SELECT alpha, split, sqrt(avg(pow(y - b0 - bx * x - bz * wind, 2))) AS rmse FROM marked, r GROUP BY alpha, split), w AS (SELECT alpha, max(rmse) FILTER (WHERE split = 'validation') AS v, max(rmse) FILTER (WHERE split = 'test') AS z FROM e GROUP BY alpha)
    SELECT CAST(trial AS INTEGER) AS trial, '[(''alpha'', ' || alpha || ')]' AS parameters, round(v, 5) AS validation, CASE WHEN v = (SELECT min(v) FROM w) THEN round(z, 5) END AS test, v = (SELECT min(v) FROM w) AS best FROM al JOIN w USING (alpha)""")
def _(t):
    fit = lambda rows, c: G.ridge_fit(rows, ["x", "wind"], "y", c["alpha"])
    rmse = lambda rows: E.evaluate(rows.withColumnRenamed("y", "y_true")).first()["rmse"]
    return _rounded(M.search(t.marked, _TRIED, fit, rmse)[1], [], 5)


@query("O_M6_generalisation_gap", """WITH w AS (SELECT model, stage, feature_set, max(rmse) FILTER (WHERE split = 'train') AS a, max(rmse) FILTER (WHERE split = 'validation') AS b, max(r2) FILTER (WHERE split = 'train') AS c, max(r2) FILTER (WHERE split = 'validation') AS e FROM results GROUP BY model, stage, feature_set)
    SELECT model, stage, feature_set, round(b - a, 5) AS rmse_gap, round((b - a) / a, 5) AS relative_gap, round(c - e, 5) AS r2_gap, CASE WHEN (b - a) / a > 0.001 AND c - e > 0.001 THEN 'high' WHEN (b - a) / a > 0.001 OR c - e > 0.001 THEN 'moderate' ELSE 'low' END AS risk FROM w""")
def _(t):
    value = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{c}_{s}")
    wide = t.results.groupBy("model", "stage", "feature_set").agg(*[value(c, s) for c in ("rmse", "r2") for s in ("train", "validation")])
    out = E.generalisation_gap(wide, 0.001, 0.001)
    return _rounded(out.select("model", "stage", "feature_set", "rmse_gap", "relative_gap", "r2_gap", "risk"), [], 5)


@query("O_M7_learning_curve", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY k, split ORDER BY tick) AS r, count(*) OVER (PARTITION BY k, split) AS c FROM marked), f AS (SELECT unnest([1, 2, 3, 4, 5]) AS st),
    s AS (SELECT st, {_SUMS} FROM m, f WHERE split = 'train' AND r <= greatest(1, ceil(c * st / 5.0)) GROUP BY st), b AS ({_ridge_sql('s', '10')}),
    tr AS (SELECT b.st, sqrt(avg(pow(y - b0 - bx * x - bz * wind, 2))) AS e FROM m, b WHERE split = 'train' AND r <= greatest(1, ceil(c * b.st / 5.0)) GROUP BY b.st), va AS (SELECT b.st, sqrt(avg(pow(y - b0 - bx * x - bz * wind, 2))) AS e FROM m, b WHERE split = 'validation' GROUP BY b.st)
    SELECT b.st / 5.0 AS fraction, CAST(b.n AS BIGINT) AS n, round(tr.e, 5) AS rmse_train, round(va.e, 5) AS rmse_validation FROM b JOIN tr ON tr.st = b.st JOIN va ON va.st = b.st""")
def _(t):
    return _rounded(G.learning_curve(t.marked, ["x", "wind"], "y", 10.0, "k", "tick"), [], 5)


@query("O_M7_curve_by_entity", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY k, split ORDER BY tick) AS r, count(*) OVER (PARTITION BY k, split) AS c FROM marked), f AS (SELECT unnest([1, 2, 3, 4, 5]) AS st),
    s AS (SELECT st, {_SUMS} FROM m, f WHERE split = 'train' AND r <= greatest(1, ceil(c * st / 5.0)) GROUP BY st), b AS ({_ridge_sql('s', '10')})
    SELECT b.st / 5.0 AS fraction, CAST(m.k AS VARCHAR) AS entity, count(*) AS n, round(sqrt(avg(pow(m.y - b0 - bx * m.x - bz * m.wind, 2))), 4) AS rmse,
    CASE WHEN sum(m.y * m.y) - sum(m.y) * sum(m.y) / count(*) > 1e-9 THEN round(1 - sum(pow(m.y - b0 - bx * m.x - bz * m.wind, 2)) / (sum(m.y * m.y) - sum(m.y) * sum(m.y) / count(*)), 4) END AS r2 FROM m, b WHERE m.split = 'validation' GROUP BY b.st, m.k""")
def _(t):
    return _rounded(G.learning_curve_by_entity(t.marked, ["x", "wind"], "y", 10.0, "k", "tick"), [], 4)


@query("O_M8_leave_one_entity_out", f"""WITH o AS (SELECT k, {_SUMS} FROM daily GROUP BY k), a AS (SELECT {_SUMS} FROM daily), s AS (SELECT o.k, a.n - o.n AS n, a.sx - o.sx AS sx, a.sz - o.sz AS sz, a.sy - o.sy AS sy, a.sxx - o.sxx AS sxx, a.sxz - o.sxz AS sxz, a.szz - o.szz AS szz, a.sxy - o.sxy AS sxy, a.szy - o.szy AS szy FROM o, a), b AS ({_ridge_sql('s', '10')})
    SELECT CAST(d.k AS VARCHAR) AS entity, count(*) AS n, round(sqrt(avg(pow(y - b0 - bx * x - bz * wind, 2))), 5) AS rmse, round(1 - sum(pow(y - b0 - bx * x - bz * wind, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 5) AS r2 FROM daily d JOIN b ON b.k = d.k GROUP BY d.k HAVING count(*) >= 30""")
def _(t):
    return _rounded(G.leave_one_entity_out(t.daily, ["x", "wind"], "y", 10.0, "k"), [], 5)


@query("O_M8_left_out_summary", f"""WITH o AS (SELECT k, {_SUMS} FROM daily GROUP BY k), a AS (SELECT {_SUMS} FROM daily), s AS (SELECT o.k, a.n - o.n AS n, a.sx - o.sx AS sx, a.sz - o.sz AS sz, a.sy - o.sy AS sy, a.sxx - o.sxx AS sxx, a.sxz - o.sxz AS sxz, a.szz - o.szz AS szz, a.sxy - o.sxy AS sxy, a.szy - o.szy AS szy FROM o, a), b AS ({_ridge_sql('s', '10')}),
    p AS (SELECT d.k, 'ridge' AS model, y, b0 + bx * x + bz * wind AS p FROM daily d JOIN b ON b.k = d.k UNION ALL SELECT d.k, 'network_mean', y, s.sy / s.n FROM daily d JOIN s ON s.k = d.k), l AS (SELECT k FROM daily GROUP BY k HAVING count(*) >= 30), r AS (SELECT k, model, 1 - sum(pow(y - p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM p SEMI JOIN l ON l.k = p.k GROUP BY k, model),
    m AS (SELECT r.model, count(*) AS entities, avg(r.r2) AS mean_r2, quantile_cont(r.r2, 0.5) AS median_r2, min(r.r2) AS worst_r2, max(r.r2) AS best_r2, count_if(r.r2 > c.r2) AS n_better FROM r JOIN r c ON c.k = r.k AND c.model = 'network_mean' GROUP BY r.model),
    g AS (SELECT model, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum(pow(y - p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM p SEMI JOIN l ON l.k = p.k GROUP BY model)
    SELECT m.model, entities, round(mean_r2, 5) AS mean_r2, round(median_r2, 5) AS median_r2, round(worst_r2, 5) AS worst_r2, round(best_r2, 5) AS best_r2, CASE WHEN m.model <> 'network_mean' THEN CAST(n_better AS BIGINT) END AS n_better, round(rmse, 5) AS pooled_rmse, round(mae, 5) AS pooled_mae, round(r2, 5) AS pooled_r2 FROM m JOIN g ON g.model = m.model""")
def _(t):
    return _rounded(G.summarise_left_out(G.left_out_predictions(t.daily, ["x", "wind"], "y", 10.0, "k")), [], 5)


def _left_out_trees_sql() -> str:
    made, used = [], []
    for g in range(4):
        text = _split_sql(f"g{g}", f"tr{g}", "y").replace(f"SELECT 'kind' AS f, CAST(kind AS DOUBLE) AS v, y AS t FROM tr{g} UNION ALL ", "")
        made.append(f"tr{g} AS (SELECT kind, flag, slot, y FROM daily WHERE kind <> {g}), {text}")
        used.append(f"SELECT kind, 'tree' AS model, y, {_SIDE} AS p FROM daily, g{g}_b WHERE kind = {g} UNION ALL SELECT kind, 'network_mean', y, (SELECT avg(y) FROM tr{g}) FROM daily WHERE kind = {g}")
    return f"""WITH {", ".join(made)}, p AS ({" UNION ALL ".join(used)}), r AS (SELECT kind, model, 1 - sum(pow(y - p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM p GROUP BY kind, model),
    m AS (SELECT r.model, count(*) AS entities, avg(r.r2) AS mean_r2, quantile_cont(r.r2, 0.5) AS median_r2, min(r.r2) AS worst_r2, max(r.r2) AS best_r2, count_if(r.r2 > c.r2) AS n_better FROM r JOIN r c ON c.kind = r.kind AND c.model = 'network_mean' GROUP BY r.model),
    g AS (SELECT model, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum(pow(y - p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM p GROUP BY model)
    SELECT m.model, entities, round(mean_r2, 5) AS mean_r2, round(median_r2, 5) AS median_r2, round(worst_r2, 5) AS worst_r2, round(best_r2, 5) AS best_r2, CASE WHEN m.model <> 'network_mean' THEN CAST(n_better AS BIGINT) END AS n_better, round(rmse, 5) AS pooled_rmse, round(mae, 5) AS pooled_mae, round(r2, 5) AS pooled_r2 FROM m JOIN g ON g.model = m.model"""


@query("O_M8_left_out_trees", _left_out_trees_sql())
def _(t):
    fits = {"tree": lambda rows: M.tree_fit(rows, ["flag", "slot"], "y", depth=1)}
    return _rounded(G.summarise_left_out(M.leave_one_out(t.daily, "kind", fits, "y")), [], 5)


@query("O_M9_ablation", f"""WITH s AS (SELECT {_SUMS} FROM marked WHERE split = 'train'), f AS ({_ridge_sql('s', '10')}), g AS (SELECT 'full' AS variant, b0, bx, bz FROM f UNION ALL SELECT 'minus drivers', (sy - bz * sz) / n, 0.0, bz FROM (SELECT *, (szy - sz * sy / n) / (szz - sz * sz / n + 10) AS bz FROM s) u
    UNION ALL SELECT 'minus weather', (sy - bx * sx) / n, bx, 0.0 FROM (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n + 10) AS bx FROM s) u2), e AS (SELECT variant, sqrt(avg(pow(y - b0 - bx * x - bz * wind, 2)) FILTER (WHERE split = 'validation')) AS v, sqrt(avg(pow(y - b0 - bx * x - bz * wind, 2)) FILTER (WHERE split = 'test')) AS z FROM marked, g GROUP BY variant)
    SELECT variant, round(v, 5) AS rmse_validation, round(z, 5) AS rmse_test, round(v - (SELECT v FROM e WHERE variant = 'full'), 5) AS change_validation, round(z - (SELECT z FROM e WHERE variant = 'full'), 5) AS change_test FROM e""")
def _(t):
    out = G.ablation(t.marked, {"drivers": ["x"], "weather": ["wind"]}, "y", 10.0)
    return _rounded(out.select("variant", "rmse_validation", "rmse_test", "change_validation", "change_test"), [], 5)


#: Columns, families, unions and parts of the ablation of all variants, and the columns that each variant is without.
_ABLATED = ["x", "n", "wind", "rain", "xw", "flag"]
_FAMILIES = {"drivers": ["x", "n"], "weather": ["wind", "rain"], "both": ["xw"], "calendar": ["flag"]}
_UNIONS = {"ALL drivers": ["drivers", "both"], "ALL weather": ["weather", "both"], "ALL drivers + calendar": ["ALL drivers", "calendar"]}
_PARTS = {"part: count": ["n"], "part: volume": ["x"]}
_EXCEPT = {"ALL drivers except count": ("ALL drivers", "part: count")}


def _ablation_sql() -> str:
    """Gauss-Jordan elimination of each variant's columns, of penalised products about the means, and errors from products."""
    removals = G.ablation_removals(_FAMILIES, _UNIONS, _PARTS, _EXCEPT)
    columns = [*_ABLATED, "slot"]
    last = len(columns) + 1  # of the target; 0 is the constant
    uses = {"full": _ABLATED, **{f"minus {n}": [c for c in _ABLATED if c not in cs] for n, cs in removals.items()}, "no weights": _ABLATED, "no pruning": columns}
    listed = ", ".join(f"('{v}', {'1' if v == 'no weights' else '0'}, {len(cs)}, [{', '.join(str(columns.index(c) + 1) for c in cs)}])" for v, cs in uses.items())
    steps = ", ".join(
        f"""m{k} AS MATERIALIZED (SELECT a.variant, a.i, a.j, CASE WHEN NOT list_contains(u.uses, {k}) THEN a.v WHEN a.i = {k} THEN a.v / p.v ELSE a.v - b.v * c.v / p.v END AS v FROM m{k - 1} a JOIN u ON u.variant = a.variant JOIN m{k - 1} b ON b.variant = a.variant AND b.i = a.i AND b.j = {k}
        JOIN m{k - 1} c ON c.variant = a.variant AND c.i = {k} AND c.j = a.j JOIN m{k - 1} p ON p.variant = a.variant AND p.i = {k} AND p.j = {k})"""
        for k in range(1, last)
    )
    return f"""WITH z AS MATERIALIZED (SELECT row_id, split, rain + 1 AS w, unnest([1.0, {", ".join("x * wind" if c == "xw" else f"CAST({c} AS DOUBLE)" for c in columns)}, y]) AS v, unnest(range(0, {last + 1})) AS i FROM marked),
    g AS MATERIALIZED (SELECT a.split, a.i, b.i AS j, sum(a.v * b.v) AS p, sum(a.w * a.v * b.v) AS pw FROM z a JOIN z b ON a.row_id = b.row_id GROUP BY ALL), u AS (SELECT * FROM (VALUES {listed}) AS v(variant, plain, n_features, uses)),
    f AS MATERIALIZED (SELECT variant, i, j, CASE WHEN plain = 1 THEN p ELSE pw END AS v FROM u, g WHERE split = 'train'), t AS (SELECT variant, v AS n FROM f WHERE i = 0 AND j = 0), h AS MATERIALIZED (SELECT variant, j, v FROM f WHERE i = 0),
    m0 AS MATERIALIZED (SELECT f.variant, f.i, f.j, f.v - a.v * b.v / n + CASE WHEN f.i = f.j AND f.i < {last} THEN 10 ELSE 0 END AS v FROM f JOIN t ON t.variant = f.variant JOIN h a ON a.variant = f.variant AND a.j = f.i JOIN h b ON b.variant = f.variant AND b.j = f.j WHERE f.i > 0 AND f.j > 0),
    {steps}, beta AS (SELECT m.variant, m.i, m.v FROM m{last - 1} m JOIN u ON u.variant = m.variant WHERE m.j = {last} AND list_contains(u.uses, m.i)), base AS (SELECT t.variant, 0 AS i, (SELECT v FROM h WHERE h.variant = t.variant AND h.j = {last}) / n - (SELECT sum(b.v * h.v) FROM beta b JOIN h ON h.variant = b.variant AND h.j = b.i WHERE b.variant = t.variant) / n AS v FROM t),
    e AS (SELECT variant, i, -v AS v FROM beta UNION ALL SELECT variant, i, -v FROM base UNION ALL SELECT variant, {last}, 1.0 FROM u), q AS (SELECT a.variant, g.split, sum(a.v * b.v * g.p) AS sse FROM e a JOIN e b ON b.variant = a.variant JOIN g ON g.i = a.i AND g.j = b.i WHERE g.split <> 'train' GROUP BY a.variant, g.split),
    k AS (SELECT split, max(p) FILTER (WHERE i = 0 AND j = 0) AS n, max(p) FILTER (WHERE i = {last} AND j = {last}) - pow(max(p) FILTER (WHERE i = 0 AND j = {last}), 2) / max(p) FILTER (WHERE i = 0 AND j = 0) AS sst FROM g GROUP BY split),
    sc AS (SELECT variant, max(sqrt(sse / n)) FILTER (WHERE q.split = 'validation') AS a, max(1 - sse / sst) FILTER (WHERE q.split = 'validation') AS b, max(sqrt(sse / n)) FILTER (WHERE q.split = 'test') AS c, max(1 - sse / sst) FILTER (WHERE q.split = 'test') AS d FROM q JOIN k ON k.split = q.split GROUP BY variant)
    SELECT s.variant, u.n_features, round(s.a, 5) AS rmse_validation, round(s.b, 5) AS r2_validation, round(s.c, 5) AS rmse_test, round(s.d, 5) AS r2_test, round(s.a - f.a, 5) AS change_validation, round(s.b - f.b, 5) AS change_r2_validation, round(s.c - f.c, 5) AS change_test, round(s.d - f.d, 5) AS change_r2_test
    FROM sc s JOIN u ON u.variant = s.variant, (SELECT * FROM sc WHERE variant = 'full') f"""


@query("O_M9_ablation_all", _ablation_sql())
def _(t):
    rows = t.marked.withColumns({"xw": F.col("x") * F.col("wind"), "w": F.col("rain") + 1})
    return _rounded(G.ablation(rows, _FAMILIES, "y", 10.0, "w", unions=_UNIONS, parts=_PARTS, excepting=_EXCEPT, added=["slot"]), [], 5)


@query("O_M9_ablation_of_trees", f"""WITH tr AS (SELECT kind, flag, slot, y FROM marked WHERE split = 'train'), {_split_sql("full", "tr", "y")}, {_split_sql("nokind", "tr", "y").replace("SELECT 'kind' AS f, CAST(kind AS DOUBLE) AS v, y AS t FROM tr UNION ALL ", "")},
    {_split_sql("nolevels", "tr", "y").replace("SELECT 'kind' AS f, CAST(kind AS DOUBLE) AS v, y AS t FROM tr UNION ALL ", "").replace(" UNION ALL SELECT 'slot' AS f, CAST(slot AS DOUBLE) AS v, y AS t FROM tr", "")},
    e AS (SELECT 'full' AS variant, 3 AS n_features, split, y, {_SIDE} AS p FROM marked, full_b UNION ALL SELECT 'minus kind', 2, split, y, {_SIDE} FROM marked, nokind_b UNION ALL SELECT 'minus levels', 1, split, y, {_SIDE} FROM marked, nolevels_b), s AS (SELECT variant, n_features, split, count(*) AS n, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum(pow(y - p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM e WHERE split <> 'train' GROUP BY ALL)
    SELECT s.variant, s.n_features, s.split, s.n, round(s.rmse, 4) AS rmse, round(s.mae, 4) AS mae, round(s.r2, 4) AS r2, round(s.rmse - f.rmse, 4) + 0.0 AS change_rmse, round(s.r2 - f.r2, 4) + 0.0 AS change_r2 FROM s JOIN s f ON f.split = s.split AND f.variant = 'full'""")
def _(t):
    fit = lambda rows, columns: M.tree_fit(rows, columns, "y", depth=1)
    found = M.ablation(t.marked, {"kind": ["kind"], "rest": ["flag", "slot"]}, fit, "y", unions={"all": ["kind", "rest"]}, parts={"levels": ["kind", "slot"]})
    out = _rounded(found.filter("variant <> 'minus rest'"), [], 4)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("change_rmse", "change_r2")})  # no negative zeros


_E = "round(sqrt(avg(pow(y_true - y_pred, 2))), 5) AS rmse, round(avg(abs(y_true - y_pred)), 5) AS mae"
_R2 = "1 - sum(pow(y_true - y_pred, 2)) / (sum(y_true * y_true) - sum(y_true) * sum(y_true) / count(*))"


@query("O_E1_evaluate", f"SELECT model, stage, split, count(*) AS n, {_E}, round({_R2}, 5) AS r2 FROM preds GROUP BY model, stage, split")
def _(t):
    return _rounded(E.evaluate(t.preds, ["model", "stage", "split"]), [], 5)


@query("O_E2_evaluate_per_entity", f"WITH e AS (SELECT k, count(*) AS n, {_E}, CASE WHEN count(*) >= 80 THEN {_R2} END AS r2 FROM preds WHERE model = 'M1' AND stage = 'tuned' AND split = 'test' GROUP BY k) SELECT k, n, rmse, mae, round(r2, 5) AS r2, CAST(row_number() OVER (ORDER BY r2 ASC NULLS FIRST, k) AS INTEGER) AS place FROM e")
def _(t):
    rows = t.preds.filter("model = 'M1' AND stage = 'tuned' AND split = 'test'")
    return _rounded(E.evaluate_per_entity(rows, "k", 80), [], 5)


@query("O_E3_entity_median_r2", f"WITH e AS (SELECT model, stage, k, {_R2} AS r2 FROM preds WHERE split = 'test' GROUP BY model, stage, k) SELECT model, stage, round(quantile_cont(r2, 0.5), 5) AS median_r2 FROM e GROUP BY model, stage")
def _(t):
    return _rounded(E.entity_median_r2(E.evaluate(t.preds.filter("split = 'test'"), ["model", "stage", "k"]), ["model", "stage"]), [], 5)


@query("O_E4_stage_delta", "SELECT model, grain, feature_set, split, round(max(rmse) FILTER (WHERE stage = 'tuned') - max(rmse) FILTER (WHERE stage = 'default'), 5) AS delta_rmse, round(max(r2) FILTER (WHERE stage = 'tuned') - max(r2) FILTER (WHERE stage = 'default'), 5) AS delta_r2 FROM results GROUP BY model, grain, feature_set, split HAVING count(DISTINCT stage) = 2")
def _(t):
    return _rounded(E.stage_delta(t.results), [], 5)


@query("O_E5_error_breakdown", """WITH p AS (SELECT *, 'one' AS single FROM preds WHERE stage = 'default' AND split = 'test'), u AS (SELECT 'kind' AS condition, CAST(kind AS VARCHAR) AS level, * FROM p UNION ALL SELECT 'flag', CAST(flag AS VARCHAR), * FROM p)
    SELECT condition, level, model, round(sqrt(avg(pow(y_pred - y_true, 2))), 5) AS rmse, round(avg(abs(y_pred - y_true)), 5) AS mae, round(avg(y_pred - y_true), 5) AS bias, count(*) AS n, count(DISTINCT k) AS entities, round(avg(y_true), 5) AS mean_y FROM u GROUP BY condition, level, model""")
def _(t):
    rows = t.preds.filter("stage = 'default' AND split = 'test'").withColumn("single", F.lit("one"))
    return _rounded(E.error_breakdown(rows, ["kind", "flag", "single"], "k"), [], 5)


def _mixed_sql(x: str) -> str:
    """The bijection of 32-bit numbers that draws come from."""
    for shift, by in ((16, 2246822507), (13, 3266489909)):
        x = f"((xor({x}, {x} >> {shift}) * {by}) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


def _drawn_sql(index: str, stream: int, count: str) -> str:
    """A number below count from the key of a round (k0, k1) and an index in it."""
    high, low = (_mixed_sql(f"(CAST({i} AS UBIGINT) & 4294967295)") for i in (f"({index} + k{stream})", f"({index} * 2654435761 + k{stream})"))
    return f"CAST((({high} << 31) + ({low} >> 1)) % CAST({count} AS UBIGINT) AS BIGINT)"


def _keys_sql(seed: int, stream: int) -> str:
    return _mixed_sql(f"(CAST(rnd * 2654435761 + {seed * 8 + stream} AS UBIGINT) & 4294967295)")


#: Sums of blocks by set and model, draws of 1,000 rounds first from buckets of 4,096 blocks and then inside them, and the rounds' scores.
_BLOCKS = f"""s AS MATERIALIZED (SELECT k, isoyear(d) * 100 + week(d) AS wk, feature_set, model, count(*) AS n, sum(y_true) AS y, sum(y_true * y_true) AS yy, sum(pow(y_true - y_pred, 2)) AS ee, sum(abs(y_true - y_pred)) AS ae FROM preds WHERE stage = 'default' AND split = 'test' GROUP BY ALL),
    b AS MATERIALIZED (SELECT k, wk, row_number() OVER (ORDER BY k, wk) - 1 AS block FROM (SELECT DISTINCT k, wk FROM s) u), c AS (SELECT CAST(count(*) AS BIGINT) AS total FROM b), r AS MATERIALIZED (SELECT rnd, {_keys_sql(3, 0)} AS k0, {_keys_sql(3, 1)} AS k1 FROM (SELECT unnest(range(1, 1001)) AS rnd) x),
    l AS MATERIALIZED (SELECT rnd, k1, total, d // 4096 AS bucket, count(*) AS times FROM (SELECT rnd, k1, total, {_drawn_sql("place", 0, "total")} AS d FROM r, (SELECT total, unnest(range(0, total)) AS place FROM c) p) q GROUP BY ALL),
    t AS MATERIALIZED (SELECT rnd, bucket * 4096 + {_drawn_sql("(j + bucket * 1048576)", 1, "least(4096, total - bucket * 4096)")} AS block, count(*) AS times FROM (SELECT *, unnest(range(0, times)) AS j FROM l) q GROUP BY ALL),
    z AS (SELECT t.rnd, s.feature_set, s.model, sum(n * times) AS n, sum(y * times) AS y, sum(yy * times) AS yy, sum(ee * times) AS ee, sum(ae * times) AS ae FROM s JOIN b ON s.k = b.k AND s.wk = b.wk JOIN t ON t.block = b.block GROUP BY t.rnd, s.feature_set, s.model), v AS MATERIALIZED (SELECT rnd, feature_set, model, sqrt(ee / n) AS rmse, ae / n AS mae, 1 - ee / (yy - y * y / n) AS r2 FROM z)"""
_ENDS = ", ".join(f"round(quantile_cont({c}, {q}), 5) AS {c}_{n}" for c in ("r2", "rmse", "mae") for n, q in (("low", 0.025), ("high", 0.975)))


def _all_blocks(t):
    week = F.extract(F.lit("YEAROFWEEK"), "d") * 100 + F.weekofyear("d")
    return t.preds.filter("stage = 'default' AND split = 'test'").withColumn("wk", week)


@query("O_E6_block_bootstrap", f"WITH {_BLOCKS} SELECT model, {_ENDS} FROM v GROUP BY model")
def _(t):
    return _rounded(E.block_bootstrap(_all_blocks(t), ["k", "wk"], 1000, 3), [], 5)


@query("O_E6_block_bootstrap_all", f"WITH {_BLOCKS} SELECT feature_set, model, {_ENDS} FROM v GROUP BY feature_set, model")
def _(t):
    return _rounded(E.block_bootstrap(_all_blocks(t), ["k", "wk"], 1000, 3, ["feature_set", "model"]), [], 5)


@query("O_E7_compare_to_best", f"""WITH {_BLOCKS}, sc AS (SELECT model, {_R2} AS r2 FROM preds WHERE stage = 'default' AND split = 'test' GROUP BY model), be AS (SELECT model AS best FROM sc WHERE model NOT IN ('B1', 'B2') ORDER BY r2 DESC, model DESC LIMIT 1),
    q AS (SELECT v.model, be.best, v.r2 - w.r2 AS d FROM v JOIN v w ON w.rnd = v.rnd JOIN be ON w.model = be.best), o AS (SELECT model, best, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM q GROUP BY model, best)
    SELECT model, best, round(low, 5) AS low, round(high, 5) AS high, CASE WHEN model = best THEN 'best' WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'not distinguishable' END AS verdict FROM o""")
def _(t):
    return _rounded(E.compare_over_blocks(_all_blocks(t), ["k", "wk"], ["B1", "B2"], 1000, 3), [], 5)


@query("O_E7_compare_to_best_all", f"""WITH {_BLOCKS}, sc AS (SELECT feature_set, model, {_R2} AS r2 FROM preds WHERE stage = 'default' AND split = 'test' GROUP BY feature_set, model), be AS (SELECT feature_set, max_by(model, r2) AS best FROM sc WHERE model NOT IN ('B1', 'B2') GROUP BY feature_set),
    q AS (SELECT be.feature_set, v.model, be.best, v.r2 - w.r2 AS d FROM be JOIN v ON v.feature_set = be.feature_set OR (v.model IN ('B1', 'B2') AND v.feature_set = 'all') JOIN v w ON w.rnd = v.rnd AND w.feature_set = be.feature_set AND w.model = be.best),
    o AS (SELECT feature_set, model, best, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM q GROUP BY feature_set, model, best)
    SELECT feature_set, model, best, round(low, 5) AS low, round(high, 5) AS high, CASE WHEN model = best THEN 'best' WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'not distinguishable' END AS verdict FROM o""")
def _(t):
    return _rounded(E.compare_over_blocks(_all_blocks(t), ["k", "wk"], ["B1", "B2"], 1000, 3, group="feature_set"), [], 5)


@query("O_E8_upsert_results", "SELECT model, stage, grain, feature_set, split, round(CASE WHEN stage = 'tuned' THEN mae + 1 ELSE mae END, 5) AS mae FROM results")
def _(t):
    new = t.results.filter("stage = 'tuned'").withColumn("mae", F.col("mae") + 1)
    out = E.upsert_results(t.results, new, "mae")
    return _rounded(out.select(*E.KEY, "mae"), [], 5)


@query("O_E9_best_run_per_grain", """WITH b AS (SELECT * FROM results WHERE split = 'validation' AND model NOT IN ('B1', 'B2') QUALIFY row_number() OVER (PARTITION BY grain ORDER BY r2 DESC) = 1)
    SELECT b.grain, b.model, b.stage, b.feature_set, round(b.r2, 5) AS validation_r2, round(r.r2, 5) AS test_r2, round(r.rmse, 5) AS test_rmse FROM b LEFT JOIN results r ON r.split = 'test' AND r.grain = b.grain AND r.model = b.model AND r.stage = b.stage AND r.feature_set = b.feature_set""")
def _(t):
    return _rounded(E.best_run_per_grain(t.results, ["B1", "B2"]), [], 5)


@query("O_E10_timing_table", """WITH w AS (SELECT grain, model, feature_set, max(train_seconds) FILTER (WHERE stage = 'default') AS a, max(train_seconds) FILTER (WHERE stage = 'tuned') AS b FROM results GROUP BY grain, model, feature_set), u AS (SELECT 'daily' AS grain, 'M1' AS model, 'all' AS feature_set, count(*) / 1000.0 AS minutes FROM daily UNION ALL SELECT 'hourly', 'M1', 'all', count(*) / 1000.0 FROM daily)
    SELECT coalesce(w.grain, u.grain) AS grain, coalesce(w.model, u.model) AS model, coalesce(w.feature_set, u.feature_set) AS feature_set, round(a, 5) AS seconds_default, round(b, 5) AS seconds_tuned, round(minutes, 5) AS minutes FROM w FULL JOIN u ON w.grain = u.grain AND w.model = u.model AND w.feature_set = u.feature_set""")
def _(t):
    minutes = t.daily.agg((F.count("*") / 1000.0).alias("minutes"))
    tuning = minutes.select(F.explode(F.array(F.lit("daily"), F.lit("hourly"))).alias("grain"), F.lit("M1").alias("model"), F.lit("all").alias("feature_set"), "minutes")
    return _rounded(E.timing_table(t.results, tuning), [], 5)


@query("O_X1_linear_attribution", "SELECT row_id, feature, round(value, 5) AS value, round(phi, 5) AS phi FROM phi")
def _(t):
    return _rounded(X.linear_attribution(t.daily, LINEAR, "row_id"), [], 5)


_SHAPLEY = """WITH m AS (SELECT avg(x) AS x, avg(wind) AS wind, avg(rain) AS rain FROM daily) SELECT row_id, 'drivers' AS family, round(1.5 * (d.x - m.x), 5) AS phi FROM daily d, m UNION ALL SELECT row_id, 'weather', round(-0.25 * (d.wind - m.wind) + 0.5 * (d.rain - m.rain), 5) FROM daily d, m"""


@query("O_X2_family_shapley", _SHAPLEY)
def _(t):
    return _rounded(X.family_shapley(t.daily, LINEAR, {"drivers": ["x"], "weather": ["wind", "rain"]}, "row_id"), [], 5)


class _Product:
    """x times wind, and rain."""

    def transform(self, df, name="y_pred"):
        return df.withColumn(name, F.col("x") * F.col("wind") + F.col("rain"))


@query("O_X2_family_shapley_all", """WITH m AS (SELECT avg(x) AS x, avg(wind) AS wind, avg(rain) AS rain FROM daily), v AS (SELECT row_id, d.x - m.x AS dx, d.wind - m.wind AS dw, d.rain - m.rain AS dr, m.x AS mx, m.wind AS mw FROM daily d, m)
    SELECT row_id, 'drivers' AS family, round(dx * mw + dx * dw / 2, 4) AS phi FROM v UNION ALL SELECT row_id, 'wind', round(dw * mx + dx * dw / 2, 4) FROM v UNION ALL SELECT row_id, 'rain', round(dr, 4) FROM v""")
def _(t):
    return _rounded(X.family_shapley(t.daily, _Product(), {"drivers": ["x"], "wind": ["wind"], "rain": ["rain"]}, "row_id"), [], 4)


@query("O_X2_family_interactions", """WITH m AS (SELECT avg(x) AS x, avg(wind) AS wind FROM daily), i AS (SELECT avg(abs((d.x - m.x) * (d.wind - m.wind))) AS v FROM daily d, m)
    SELECT 'drivers' AS family_a, 'wind' AS family_b, round(v, 4) AS mean_abs, 1.0 AS share FROM i UNION ALL SELECT 'drivers', 'rain', 0.0, 0.0 UNION ALL SELECT 'wind', 'rain', 0.0, 0.0""")
def _(t):
    pairs = X.family_interactions(t.daily, _Product(), {"drivers": ["x"], "wind": ["wind"], "rain": ["rain"]}, "row_id")
    return _rounded(X.interaction_table(pairs), [], 4)


_IMPORTANCE = "SELECT feature, avg(abs(phi)) AS mean_abs, corr(value, phi) AS direction FROM phi GROUP BY feature"


@query("O_X3_importance_table", f"WITH i AS ({_IMPORTANCE}) SELECT feature, round(mean_abs, 5) AS mean_abs, round(direction, 5) AS direction, round(mean_abs / sum(mean_abs) OVER (), 5) AS share, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM i")
def _(t):
    return _rounded(X.importance_table(t.phi), [], 5)


@query("O_X4_family_shares", f"WITH i AS (SELECT *, CASE WHEN feature = 'x' THEN 'drivers' ELSE 'weather' END AS family FROM ({_IMPORTANCE}) q), g AS (SELECT family, sum(mean_abs) AS total, count(*) AS n_features, arg_max(feature, mean_abs) AS top_feature FROM i GROUP BY family) SELECT family, round(total, 5) AS total, n_features, top_feature, round(total / sum(total) OVER (), 5) AS share FROM g")
def _(t):
    families = t.phi.select("feature").distinct().withColumn("family", F.when(F.col("feature") == "x", "drivers").otherwise("weather"))
    return _rounded(X.family_shares(X.importance_table(t.phi), families), [], 5)


@query("O_X5_effect_by_bins", """WITH e AS (SELECT row_id, x, wind, 1.5 * (x - avg(x) OVER ()) AS effect, gappy FROM daily), f AS (SELECT *, row_number() OVER (ORDER BY x, row_id) AS rx, row_number() OVER (ORDER BY wind, row_id) AS rw, count(*) OVER () AS n FROM e WHERE gappy IS NOT NULL),
    b AS (SELECT effect, CAST(greatest(1, ((rx - 1) * 10 + n - 2) // (n - 1)) AS INTEGER) AS driver_bin, CAST(greatest(1, ((rw - 1) * 3 + n - 2) // (n - 1)) AS INTEGER) AS modifier_bin FROM f) SELECT driver_bin, modifier_bin, round(avg(effect), 4) AS mean, round(stddev_samp(effect) / sqrt(count(*)), 4) AS sem, count(*) AS n FROM b GROUP BY driver_bin, modifier_bin""")
def _(t):
    effects = t.phi.filter("feature = 'x'").select("row_id", F.col("phi").alias("effect"))
    rows = t.daily.select("row_id", "x", "wind", F.col("gappy").isNotNull().cast("int").alias("sensor")).join(effects, "row_id")
    return _rounded(X.effect_by_bins(rows, "row_id", "x", "wind", "sensor"), [], 4)


@query("O_X6_importance_by_group", "WITH i AS (SELECT kind, feature, avg(abs(phi)) AS a, corr(value, phi) AS c FROM phi GROUP BY kind, feature), r AS (SELECT *, a / sum(a) OVER (PARTITION BY kind) AS s, row_number() OVER (PARTITION BY kind ORDER BY a DESC, feature) AS r FROM i) SELECT kind, feature, round(a, 5) AS mean_abs, round(c, 5) AS direction, round(s, 5) AS share, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 2")
def _(t):
    return _rounded(X.importance_by_group(t.phi, "kind", 2), [], 5)


@query("O_X7_case_attributions", """WITH m AS (SELECT quantile_cont(y, 0.5) AS med FROM daily), q AS (SELECT quantile_cont(wind, 1 / 3) AS low, quantile_cont(wind, 2 / 3) AS high FROM daily WHERE kind = 1),
    calm AS (SELECT row_id, y FROM daily, q WHERE kind = 1 AND wind <= low), windy AS (SELECT row_id, y FROM daily, q WHERE kind = 1 AND wind >= high), c AS (SELECT 'highest' AS "case", (SELECT row_id FROM daily ORDER BY y DESC, row_id LIMIT 1) AS row_id UNION ALL SELECT 'typical', (SELECT row_id FROM daily, m ORDER BY abs(y - med), row_id LIMIT 1)
    UNION ALL SELECT 'calm', (SELECT row_id FROM calm ORDER BY abs(y - (SELECT quantile_cont(y, 0.5) FROM calm)), row_id LIMIT 1) UNION ALL SELECT 'windy', (SELECT row_id FROM windy ORDER BY abs(y - (SELECT quantile_cont(y, 0.5) FROM windy)), row_id LIMIT 1))
    SELECT c."case", c.row_id, p.feature, round(p.value, 5) AS value, round(p.phi, 5) AS phi, CAST(row_number() OVER (PARTITION BY c."case" ORDER BY abs(p.phi) DESC, p.feature) AS INTEGER) AS place FROM c JOIN phi p ON p.row_id = c.row_id QUALIFY row_number() OVER (PARTITION BY c."case" ORDER BY abs(p.phi) DESC, p.feature) <= 2""")
def _(t):
    cases = pick_cases(t.daily, "row_id", "y", "wind", F.col("kind") == 1)
    out = X.case_attributions(t.phi, cases, "row_id", 2)
    return _rounded(out.select("case", "row_id", "feature", "value", "phi", "place"), [], 5)


def _permuted_sql(place: str) -> str:
    """Where the keyed permutation sends a place: two sides a x b, in turns moved by md5 of seed, turn and the other side."""
    left, right = f"({place} // b)", f"({place} % b)"
    for turn in range(4):
        moved = lambda side, other, m, t=turn: f"(({side} + CAST('0x' || substr(md5(seed || ':{t}:' || {other}), 1, 15) AS BIGINT)) % {m})"
        left, right = (left, moved(right, left, "b")) if turn % 2 else (moved(left, right, "a"), right)
    return f"{left} * b + {right}"


def _ways_sql(rows: str, seeds: str) -> str:
    """Table expressions ending in ways (seed, r, q): of each place r of rows the one that it is sent to."""
    return f"""size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM {rows}) u),
    way AS (SELECT seed, r, {_permuted_sql("r")} AS q, n, a, b FROM (SELECT r FROM {rows}) u, size, (VALUES {seeds}) AS v(seed) UNION ALL SELECT seed, r, {_permuted_sql("q")}, n, a, b FROM way WHERE q >= n), ways AS (SELECT seed, r, q FROM way WHERE q < n)"""


@query("O_X8_permutation_importance", f"""WITH RECURSIVE p AS (SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS r, x, wind, rain, y, 2 + 1.5 * x - 0.25 * wind + 0.5 * rain AS f FROM daily), {_ways_sql("p", "(4), (5), (6), (7), (8)")}, t AS (SELECT 1 - sum(pow(y - f, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM p),
    s AS (SELECT seed, 1 - sum(pow(o.y - (2 + 1.5 * g.x - 0.25 * o.wind + 0.5 * o.rain), 2)) / (sum(o.y * o.y) - sum(o.y) * sum(o.y) / count(*)) AS drivers, 1 - sum(pow(o.y - (2 + 1.5 * o.x - 0.25 * g.wind + 0.5 * g.rain), 2)) / (sum(o.y * o.y) - sum(o.y) * sum(o.y) / count(*)) AS weather FROM ways JOIN p o ON o.r = ways.r JOIN p g ON g.r = ways.q GROUP BY seed)
    SELECT 'drivers' AS family, round(avg(t.r2 - drivers), 5) AS drop_mean, round(stddev_pop(t.r2 - drivers), 5) AS drop_sd FROM s, t UNION ALL SELECT 'weather', round(avg(t.r2 - weather), 5), round(stddev_pop(t.r2 - weather), 5) FROM s, t""")
def _(t):
    rows = t.daily.select("row_id", "x", "wind", "rain", "y")
    return _rounded(X.permutation_importance(rows, LINEAR, {"drivers": ["x"], "weather": ["wind", "rain"]}, "row_id", "y", 5, 4), [], 5)


@query("O_X9_window_importance")
def _(t):
    rows = reshape.sequence_windows(t.marked.withColumn("target", F.col("wind") + F.col("x")), "k", "tick", ["x"], 1, 2)
    model, flat = M.window_ridge(rows, ["x"], "target", 2, 10.0, F.col("split") == "train")
    return _rounded(X.window_importance(flat, model, ["x"], 2, "row_id", "target", 1), [], 6)


@query("O_X9_two_steps", f"""WITH RECURSIVE {_WINDOW_FIT}, o AS (SELECT *, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS r FROM f), {_ways_sql("o", "(0)")},
    j AS (SELECT o.y, o.a, o.b, o.c, g.a AS a2, g.b AS b2, g.c AS c2 FROM ways JOIN o ON o.r = ways.r JOIN o g ON g.r = ways.q), p AS (SELECT y, b0 + ba * a + bb2 * b + bc2 * c AS p, b0 + ba * a2 + bb2 * b2 + bc2 * c AS p0, b0 + ba * a + bb2 * b + bc2 * c2 AS p1 FROM j, h),
    r AS (SELECT sum(pow(y - p, 2)) AS e, sum(pow(y - p0, 2)) AS e0, sum(pow(y - p1, 2)) AS e1, sum(y * y) - sum(y) * sum(y) / count(*) AS t FROM p) SELECT 'position 0' AS family, round((e0 - e) / t, 4) + 0.0 AS drop_mean, CAST(0 AS DOUBLE) AS drop_sd FROM r UNION ALL SELECT 'position 1', round((e1 - e) / t, 4) + 0.0, CAST(0 AS DOUBLE) FROM r""")
def _(t):
    model, flat = _two_steps(t)
    out = _rounded(X.window_importance(flat, model, ["x"], 2, "row_id", "y", 1), [], 4)
    return out.withColumn("drop_mean", F.col("drop_mean") + 0.0)  # no negative zeros


@query("O_X10_rank_agreement", """WITH s AS (SELECT CAST(kind AS VARCHAR) AS m, month(d) AS f, avg(y) AS v FROM daily GROUP BY 1, 2), j AS (SELECT a.m AS a, b.m AS b, a.f, a.v AS va, b.v AS vb FROM s a JOIN s b ON a.f = b.f AND a.m < b.m), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) AS rb FROM j) SELECT a, b, count(*) AS n, round(corr(ra, rb), 5) AS rho FROM r GROUP BY a, b""")
def _(t):
    scores = t.daily.groupBy(F.col("kind").cast("string").alias("method"), F.month("d").alias("family")).agg(F.avg("y").alias("value"))
    return _rounded(X.rank_agreement(scores), [], 5)


@query("O_X11_tree_importance")
def _(t):
    rows = t.marked.filter("split = 'train'")
    return M.tree_importance(M.tree_fit(rows, ["x", "wind", "rain"], "y"), rows)


@query("O_X11_one_split", f"WITH tr AS (SELECT kind, flag, slot, y FROM marked WHERE split = 'train'), {_split_sql('one', 'tr', 'y')} SELECT c AS feature, CASE WHEN c = (SELECT f FROM one_b) THEN 1.0 ELSE 0.0 END AS importance FROM (VALUES ('kind'), ('flag'), ('slot')) AS v(c)")
def _(t):
    rows = t.marked.filter("split = 'train'")
    return M.tree_importance(M.tree_fit(rows, _LEVELS, "y", depth=1), rows)


#: The event effect's design in SQL: flag, wind, rain, whether a reading is there, dummies of months, and last the target.
_EVENT = ["CAST(gap = 0 AS DOUBLE)", "wind", "rain", "CAST(gappy IS NULL AS DOUBLE)", *[f"CAST(month(d) = {m} AS DOUBLE)" for m in range(2, 13)]]


def _event_sql(target: str, percent: str, seed: int) -> str:
    """Products about the entities' means in each round of windows, then one column after the other swept out."""
    last = len(_EVENT)
    sweeps = ", ".join(
        f"""m{k} AS MATERIALIZED (SELECT a.rnd, a.i, a.j, CASE WHEN p.v > 1e-9 * d.v THEN a.v - b.v * c.v / p.v ELSE a.v END AS v FROM m{k - 1} a JOIN m{k - 1} b ON b.rnd = a.rnd AND b.i = a.i AND b.j = {k}
        JOIN m{k - 1} c ON c.rnd = a.rnd AND c.i = {k} AND c.j = a.j JOIN m{k - 1} p ON p.rnd = a.rnd AND p.i = {k} AND p.j = {k} JOIN raw d ON d.rnd = a.rnd AND d.i = {k} AND d.j = {k})"""
        for k in range(1, last)
    )
    return f"""WITH c AS (SELECT a.*, h.date AS ev, CAST(a.d - h.date AS INTEGER) AS gap FROM daily a CROSS JOIN holidays h WHERE isodow(a.d) < 6), e AS (SELECT * FROM c WHERE abs(gap) <= 15 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(gap), ev) = 1),
    z AS MATERIALIZED (SELECT row_id, k, ev, unnest([{", ".join(_EVENT)}, {target}]) AS v, unnest(range(0, {last + 1})) AS i FROM e), s AS (SELECT k, ev, i, sum(v) AS s, count(*) AS n FROM z GROUP BY k, ev, i),
    g AS (SELECT a.ev, a.i, b.i AS j, sum(a.v * b.v) AS v FROM z a JOIN z b ON a.row_id = b.row_id GROUP BY a.ev, a.i, b.i), w AS (SELECT ev, row_number() OVER (ORDER BY ev) - 1 AS pos, count(*) OVER () AS c FROM (SELECT DISTINCT ev FROM e) u),
    t AS MATERIALIZED (SELECT 0 AS rnd, ev, 1 AS times FROM w UNION ALL SELECT rnd, w.ev, count(*) FROM (SELECT rnd, CAST('0x' || substr(md5(rnd || ':' || pos || ':{seed}'), 1, 15) AS BIGINT) % c AS pick FROM w, (SELECT unnest(range(1, 201)) AS rnd) r) d JOIN w ON w.pos = d.pick GROUP BY rnd, w.ev),
    o AS MATERIALIZED (SELECT t.rnd, s.k, s.i, sum(s.s * t.times) AS s, sum(s.n * t.times) AS n FROM s JOIN t ON s.ev = t.ev GROUP BY t.rnd, s.k, s.i), raw AS MATERIALIZED (SELECT t.rnd, g.i, g.j, sum(g.v * t.times) AS v FROM g JOIN t ON g.ev = t.ev GROUP BY t.rnd, g.i, g.j),
    off AS (SELECT a.rnd, a.i, b.i AS j, sum(a.s * b.s / a.n) AS v FROM o a JOIN o b ON b.rnd = a.rnd AND b.k = a.k GROUP BY a.rnd, a.i, b.i), m0 AS MATERIALIZED (SELECT raw.rnd, raw.i, raw.j, raw.v - off.v AS v FROM raw JOIN off ON off.rnd = raw.rnd AND off.i = raw.i AND off.j = raw.j),
    {sweeps}, coef AS (SELECT a.rnd, b.v / a.v AS c FROM m{last - 1} a JOIN m{last - 1} b ON b.rnd = a.rnd AND a.i = 0 AND a.j = 0 AND b.i = 0 AND b.j = {last} JOIN raw d ON d.rnd = a.rnd AND d.i = 0 AND d.j = 0 WHERE a.v > 1e-9 * d.v), base AS (SELECT avg(v) FILTER (WHERE row_id IN (SELECT row_id FROM e WHERE gap <> 0)) AS control FROM z WHERE i = {last}),
    pct AS (SELECT rnd, {percent} AS p FROM coef, base)
    SELECT round(max(p) FILTER (WHERE rnd = 0), 4) AS effect_pct, round(quantile_cont(p, 0.025) FILTER (WHERE rnd > 0), 4) AS low, round(quantile_cont(p, 0.975) FILTER (WHERE rnd > 0), 4) AS high, CAST((SELECT count(*) FROM w) AS INTEGER) AS windows, 200 AS rounds, (SELECT count(*) FROM e) AS n, (SELECT count(DISTINCT k) FROM e) AS entities FROM pct"""


def _near_events(t):
    """Weekdays within 15 days of a holiday, with the flag, what the effect is adjusted for, and the window."""
    rows = t.daily.filter(F.weekday("d") < 5)
    rows = nearest_event_window(rows, "d", t.holidays.withColumnRenamed("date", "event_date"), 15)
    return rows.select("k", (F.col("gap_days") == 0).cast("double").alias("event"), "wind", "rain", F.col("gappy").isNull().cast("double").alias("lacks"), F.month("d").alias("month"), F.col("event_date").cast("string").alias("window"), "y", F.log1p("y").alias("log_y"))


@query("O_H1_event_effect", _event_sql("ln(1 + y)", "100 * (exp(c) - 1)", 2))
def _(t):
    return _rounded(H.event_effect(_near_events(t), "event", ["wind", "rain", "lacks"], "log_y", "window", 200, 2, entity="k", dummies=["month"]), [], 4)


@query("O_H1_event_effect_level", _event_sql("y", "100 * c / control", 5))
def _(t):
    return _rounded(H.event_effect(_near_events(t), "event", ["wind", "rain", "lacks"], "y", "window", 200, 5, False, entity="k", dummies=["month"]), [], 4)


@query("O_H2_event_by_entity", "SELECT k, round(avg(y) FILTER (WHERE flag = 0), 5) AS y_control, round(avg(y) FILTER (WHERE flag = 1), 5) AS y_event, round(100 * (avg(y) FILTER (WHERE flag = 1) - avg(y) FILTER (WHERE flag = 0)) / avg(y) FILTER (WHERE flag = 0), 5) AS y_pct FROM daily GROUP BY k HAVING count(*) FILTER (WHERE flag = 1) > 0 AND count(*) FILTER (WHERE flag = 0) > 0")
def _(t):
    return _rounded(H.event_by_entity(t.daily, "k", "flag", ["y"]), [], 5)


@query("O_H3_event_profile", """WITH c AS (SELECT k, kind, avg(y) FILTER (WHERE flag = 0) AS a, avg(y) FILTER (WHERE flag = 1) AS b FROM daily GROUP BY k, kind), r AS (SELECT kind, count(*) AS n FROM daily GROUP BY kind)
    SELECT c.kind, round(avg(100 * (b - a) / a), 5) AS mean_pct, count(*) AS entities, any_value(r.n) AS n_rows, any_value(r.n) < 0.6 * (SELECT quantile_cont(n, 0.5) FROM r) AS is_thin FROM c JOIN r ON r.kind = c.kind WHERE a IS NOT NULL AND b IS NOT NULL AND a <> 0 GROUP BY c.kind""")
def _(t):
    return _rounded(H.event_profile(t.daily, "k", "kind", "flag", "y"), [], 5)


@query("O_H4_dose_response", """WITH e AS (SELECT d.k, avg(d.x) AS x, avg(d.y) AS y, any_value(m.acct) AS acct FROM daily d JOIN dim m ON m.k = d.k GROUP BY d.k), u AS (SELECT 'all' AS subset, * FROM e UNION ALL SELECT 'near', * FROM e WHERE acct <= 5000), r AS (SELECT *, rank() OVER (PARTITION BY subset ORDER BY x) AS rx, rank() OVER (PARTITION BY subset ORDER BY y) AS ry FROM u)
    SELECT subset, count(*) AS n, round(corr(x, y), 5) AS r, round(corr(rx, ry), 3) AS rho, round(regr_slope(y, x), 5) AS slope FROM r GROUP BY subset HAVING count(*) >= 3""")
def _(t):
    rows = t.daily.join(t.dim, "k").groupBy("k").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("acct").alias("acct"))
    out = H.dose_response(rows, "x", "y", "acct", 5000)
    return out.select("subset", "n", r6(F.round("r", 5), "r"), F.round("rho", 3).alias("rho"), F.round("slope", 5).alias("slope"))
