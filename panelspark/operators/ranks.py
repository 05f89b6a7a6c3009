"""Exact order statistics of whole columns without a sort or a window over all rows.

Approximate quantiles cut each column into cells; one pass counts the cells in every task. A wanted rank
then lies in one known cell, and only the values in those cells are counted one by one. What reaches the
driver is a number of cells a column, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import dealt, saved, ship_code

CELLS = 512


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]]) -> dict[str, list[tuple[float, int, int]]]:
    """For each column and each of its ranks, from 1: the value there, how many are less, and how many are equal.

    Columns are taken as doubles (integers up to 2^53 are exact); NULL and NaN have no rank. Ranks must exist."""
    names = [c for c in ranks if len(ranks[c])]
    if not names:
        return {c: [] for c in ranks}
    ship_code(df.sparkSession)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    fractions = [i / CELLS for i in range(1, CELLS)]
    near = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in rows.columns])
    cuts = near.agg(*[F.percentile_approx(c, fractions, 8 * CELLS).alias(c) for c in rows.columns]).first()
    # each cut twice, so that a value that many rows have is a cell of its own
    edges = [np.unique(np.concatenate((c, np.nextafter(c, np.inf)))) for c in (np.array(x or [0.0], float) for x in cuts)]

    def cells(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i in range(len(edges)):
            v = pdf.iloc[:, i].to_numpy(float, na_value=np.nan)
            v = v[~np.isnan(v)]
            yield i, v, np.searchsorted(edges[i], v, side="right")

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(len(e) + 1, np.int64) for e in edges]
        for pdf in batches:
            for i, _, at in cells(pdf):
                held[i] += np.bincount(at, minlength=len(held[i]))
        yield pd.DataFrame({"i": np.repeat(np.arange(len(held)), [len(h) for h in held]), "cell": np.concatenate([np.arange(len(h)) for h in held]), "n": np.concatenate(held)}).query("n > 0")

    counted = rows.mapInPandas(histogram, "i int, cell int, n long").groupBy("i", "cell").agg(F.sum("n").alias("n")).toPandas()
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    targets: list[tuple[int, int, int, int]] = []  # column, cell, rank inside it, rank
    for i, name in enumerate(names):
        own = counted[counted["i"] == i].sort_values("cell")
        upto = own["n"].cumsum().to_numpy()
        for r in set(ranks[name]):
            at = int(np.searchsorted(upto, r))
            cell, n = int(own["cell"].iloc[at]), int(own["n"].iloc[at])
            below = int(upto[at]) - n
            if 0 < cell < len(edges[i]) and edges[i][cell] == np.nextafter(edges[i][cell - 1], np.inf):
                found[i, r] = (float(edges[i][cell - 1]), below, n)
            else:
                targets.append((i, cell, r - below, r))
    if targets:
        open_cells = [np.array(sorted({c for j, c, _, _ in targets if j == i}), np.int64) for i in range(len(names))]

        def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, v, at in cells(pdf):
                    hit = np.isin(at, open_cells[i])
                    if hit.any():
                        values, first, n = np.unique(v[hit], return_index=True, return_counts=True)
                        yield pd.DataFrame({"i": i, "cell": at[hit][first], "value": values, "n": n})

        values = rows.mapInPandas(inside, "i int, cell int, value double, n long").groupBy("i", "cell", "value").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("i", "cell").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
        wanted = F.broadcast(df.sparkSession.createDataFrame(targets, "i int, cell int, inside long, r long"))  # a row a rank
        hits = values.withColumn("upto", upto).join(wanted, ["i", "cell"]).filter("upto - n < inside AND inside <= upto")
        for row in hits.collect():
            found[row["i"], row["r"]] = (row["value"], row["r"] - row["inside"] + row["upto"] - row["n"], row["n"])
    place = {c: i for i, c in enumerate(names)}
    return {c: [found[place[c], r] for r in ranks[c]] for c in ranks}


def percentiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact percentiles of whole columns, between neighbours by interpolation; None for a column without values.

    The columns are saved first, as each pass reads them: what made df runs once."""
    if not wanted:
        return {}
    df = saved(df.select(*[F.col(c).cast("double").alias(c) for c in wanted]), "columns")
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    counts = df.agg(*[F.count_if(there(c)).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
    size = {c: counts[f"n{i}"] for i, c in enumerate(wanted)}
    place = {c: [q * (size[c] - 1) for q in qs] for c, qs in wanted.items()}
    ranks = {c: sorted({r for p in place[c] for r in (math.floor(p) + 1, math.ceil(p) + 1)}) if size[c] else [] for c in wanted}
    values = {c: dict(zip(ranks[c], (v for v, _, _ in found), strict=True)) for c, found in order_statistics(df, ranks).items()}

    def between(c: str, p: float) -> float | None:
        if not size[c]:
            return None
        low, high = math.floor(p), math.ceil(p)
        a, b = values[c][low + 1], values[c][high + 1]
        return a if low == high else (high - p) * a + (p - low) * b

    return {c: [between(c, p) for p in place[c]] for c in wanted}


#: Groups up to this size have all their values sorted; the accuracy of the sketches of larger ones.
SMALL, ACCURACY = 5000, 10_000


def group_percentiles(df: DataFrame, group: str, column: str, wanted: Sequence[float]) -> DataFrame:
    """(group, n, q): exact percentiles of column in each group, q[i] for wanted[i], between neighbours by interpolation, and
    the number of values. NULL and NaN have no rank; groups without values, and the NULL group, are left out.

    Groups up to SMALL values are sorted where they are dealt. Of larger ones, mergeable sketches give bounds around each
    percentile, as near as two ten-thousandths of its rows. One pass then counts the values below the bounds as one and those
    inside one by one, in every task, so that a group of any size is read by all tasks and what is sorted is the small part inside."""
    v = F.col(column).cast("double")
    rows = saved(df.select(F.col(group).alias("g"), v.alias("v")).filter(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")), "values")
    counts = saved(rows.groupBy("g").agg(F.count("*").alias("n")), "counts")
    small, found = rows, None
    if not counts.filter(F.col("n") > SMALL).isEmpty():
        small = rows.join(counts.filter(F.col("n") <= SMALL).select("g"), "g", "left_semi")
        found = _large_percentiles(rows.join(counts.filter(F.col("n") > SMALL).select("g"), "g", "left_semi"), wanted)
        small = saved(small, "small")
    small = dealt(small, "g")
    own = W.partitionBy("g")
    small = small.withColumns({"_rank": F.row_number().over(own.orderBy("v")) - 1, "n": F.count("*").over(own)})
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in wanted]
    at = lambda r: F.min(F.when(F.col("_rank") == r, F.col("v")))
    ends = small.groupBy("g").agg(F.first("n").alias("n"), *[e for j, p in enumerate(places) for e in (at(F.floor(p)).alias(f"_low{j}"), at(F.ceil(p)).alias(f"_high{j}"))])
    out = ends.select("g", "n", F.array(*[_between(p, F.col(f"_low{j}"), F.col(f"_high{j}")) for j, p in enumerate(places)]).alias("q"))
    return (out if found is None else out.unionByName(found)).withColumnRenamed("g", group)


def _between(place: Column, low: Column, high: Column) -> Column:
    below, above = F.floor(place), F.ceil(place)
    return F.when(below == above, low).otherwise((above - place) * low + (place - below) * high)


def _large_percentiles(rows: DataFrame, wanted: Sequence[float]) -> DataFrame:
    """group_percentiles of (g, v), whose groups have more than SMALL values."""
    near = 1 / SMALL + 2 / ACCURACY
    ends = [min(max(q + e, 0.0), 1.0) for q in wanted for e in (-near, near)]
    bounds = saved(rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("_b")), "bounds")

    def part(j: int) -> Column:
        """0 for a value below the j-th percentile's bounds, 1 inside, 2 above; and the value inside."""
        low, high = F.col("_b")[2 * j], F.col("_b")[2 * j + 1]
        if wanted[j] - near <= 0:
            low = F.lit(None).cast("double")
        side = F.when(F.col("v") < low, 0).when(F.col("v") > high, 2).otherwise(1)
        return F.struct(F.lit(j).alias("j"), side.alias("side"), F.when(side == 1, F.col("v")).alias("value"))

    met = rows.join(bounds, "g").select("g", "n", F.inline(F.array(*[part(j) for j in range(len(wanted))]))).filter("side < 2")
    counted = met.groupBy("g", "j", "side", "value").agg(F.first("n").alias("n"), F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("g", "j").orderBy("side", "value").rowsBetween(W.unboundedPreceding, 0))
    place = F.element_at(F.array(*[F.lit(float(q)) for q in wanted]), F.col("j") + 1) * (F.col("n") - 1)
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("value")))
    found = counted.withColumns({"_upto": upto, "_place": place}).groupBy("g", "j").agg(F.first("n").alias("n"), F.first("_place").alias("_p"), at(F.floor("_place")).alias("_low"), at(F.ceil("_place")).alias("_high"))
    value = _between(F.col("_p"), F.col("_low"), F.col("_high"))
    own = [F.max(F.when(F.col("j") == j, value)) for j in range(len(wanted))]
    return found.groupBy("g").agg(F.max("n").alias("n"), F.array(*own).alias("q"))


def literal(value: float | None) -> Column:
    return F.lit(value).cast("double")


def bins(df: DataFrame, columns: dict[str, int], row: str) -> dict[str, Column]:
    """For each column and number of bins, the bin from 1 on of the row's rank by (column, row), cut at the
    quantiles of the ranks as equal_bins cuts them. NULL without a value. row: distinct integers below 2^53.

    df is read several times: give a saved table."""
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    ranks = {c: [b * (counts[f"n{i}"] - 1) // n + 1 for b in range(1, n)] if counts[f"n{i}"] > 1 else [] for i, (c, n) in enumerate(columns.items())}
    cuts = order_statistics(df, ranks)
    # the last row of each bin: among equal values, by the row
    ties = {f"t{i}_{b}": (c, v, r - below) for i, c in enumerate(columns) for b, ((v, below, _), r) in enumerate(zip(cuts[c], ranks[c], strict=True))}
    tied = df.select(*[F.when(F.col(c) == v, F.col(row)).alias(name) for name, (c, v, _) in ties.items()]) if ties else df
    last = {name: found[0][0] for name, found in order_statistics(tied, {name: [r] for name, (_, _, r) in ties.items()}).items()}
    out = {}
    for i, c in enumerate(columns):
        bin_ = F.lit(1)
        for b, (v, _, _) in enumerate(cuts[c]):
            beyond = (F.col(c) > v) | ((F.col(c) == v) & (F.col(row) > last[f"t{i}_{b}"]))
            bin_ = bin_ + beyond.cast("int")
        out[c] = F.when(F.col(c).isNotNull(), bin_).cast("int")
    return out
