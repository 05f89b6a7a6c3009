"""Embedding near-dedup: all pairs by cosine, in tiles of PCA-ordered coordinates.

Unit vectors are turned so that leading coordinates carry most of their squares. Cells of a tree
over the leading coordinates are compared only if their bounding boxes are near enough. A tile of
two cells accumulates inner products over the leading coordinates; what the rest can add is at most
the product of the suffix norms, and pairs that cannot reach the threshold stop there.

Equal vectors are one class, compared once. Tiles return numbers of links and local components, not
pairs. The comparison is exact: its worst case, all vectors in one place, is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import Scratch
from .streams import key_runs

COSINE = 0.9
#: Bound of the sample that the tree is fitted on; cells at most; leading coordinates of boxes; rows of a tile.
SAMPLE, CELLS, LEAD, TILE = 8192, 1024, 8, 4096
#: Coordinates between two tests of the bound, and rows compared at once.
STEP, BLOCK = 24, 512
_SLACK = 1e-9


def _slack_single(d: int) -> float:
    """Rounding of an inner product of unit vectors of d coordinates in single precision, at most."""
    return 1e-6 + 2.0**-23 * (d + 4)


def usable_vectors(vectors: DataFrame) -> F.Column:
    """Whether a row can be linked: an id, and finite components that aren't all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some, F.lit(False))


def _matrix(column, d: int = 0) -> np.ndarray:
    """Rows of d coordinates, or as many as the longest has; shorter ones end in zeros."""
    out = np.zeros((len(column), max(d, max(map(len, column), default=0))))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(d: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                u = _unit(_matrix(pdf["embedding"], d))
                total += u.T @ u
        yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

    return run


def rotation(vectors: DataFrame) -> np.ndarray | None:
    """Columns: principal directions of all unit vectors, the strongest first. Only their second
    moments, the square of the dimension, come to the driver."""
    d = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if d is None:
        return None
    rows = vectors.select("embedding").mapInPandas(_moments(d), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    moments = np.zeros(d * d)
    moments[rows["place"]] = rows["value"]
    return np.ascontiguousarray(np.linalg.eigh(moments.reshape(d, d))[1][:, ::-1])


class Tree:
    """Splits of a binary tree in level order: coordinate and value."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros(2**depth, np.int64), np.zeros(2**depth)
        held = {1: sample}
        for node in range(1, 2**depth):
            x = held.pop(node)
            if len(x):
                self.axis[node] = a = int(x.std(0).argmax())
                self.value[node] = np.median(x[:, a])
            right = x[:, self.axis[node]] > self.value[node]
            held[2 * node], held[2 * node + 1] = x[~right], x[right]

    def cell(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.value[node])
        return node - 2**self.depth


def _celled(turn: np.ndarray, tree: Tree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                lead = (_unit(_matrix(pdf["embedding"], len(turn))) @ turn)[:, :LEAD]
                yield pdf.assign(cell=tree.cell(lead), lead=list(lead))

    return run


def near_cells(boxes: pd.DataFrame, cosine: float) -> list[tuple[int, int]]:
    """Pairs (a <= b) of cells whose boxes, and balls around their centres, are no farther apart than vectors of that cosine."""
    cell = boxes["cell"].to_numpy()
    low, high, centre = (_matrix(boxes[c]) for c in ("low", "high", "centre"))
    reach = boxes["radius"].to_numpy(float)
    out = []
    for i in range(len(cell)):
        gap = np.maximum(0, np.maximum(low[i] - high, low - high[i]))
        apart = np.maximum(0, np.sqrt(((centre[i] - centre) ** 2).sum(1)) - reach[i] - reach - _SLACK)
        near = np.maximum((gap * gap).sum(1), apart * apart) <= 2 - 2 * cosine + _SLACK
        out += [(int(cell[i]), int(cell[j])) for j in np.flatnonzero(near & (cell >= cell[i]))]
    return out


def _suffix_norms(p: np.ndarray, done: int) -> np.ndarray:
    return np.sqrt(np.maximum((p[:, done:] ** 2).sum(1), 0))


def compare(x: np.ndarray, y: np.ndarray, turn: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y have at least that cosine, in double precision.

    The leading coordinates with the suffix norm as one more make a product that no cosine exceeds, in
    single precision with slack. While many pairs reach the threshold it is made of more coordinates;
    few pairs are followed one by one. A pair that stays is settled by the vectors as they came.
    """
    px, py = _unit(x) @ turn, _unit(y) @ turn
    d = px.shape[1]
    slack = _slack_single(d)
    out = np.zeros((len(x), len(y)), bool)

    def leading(p: np.ndarray, done: int) -> np.ndarray:
        return np.column_stack([p[:, :done], _suffix_norms(p, done)]).astype(np.float32)

    steps = [*range(STEP, d, STEP), d]
    right = {}
    for lo in range(0, len(x), BLOCK):
        a = px[lo : lo + BLOCK]
        for done in steps:
            if done not in right:
                right[done] = leading(py, done)
            bound = leading(a, done) @ right[done].T
            alive = bound >= cosine - slack
            count = int(np.count_nonzero(alive))
            if count * 50 < alive.size:
                break
        if not count:
            continue
        sure = np.zeros_like(alive)
        if done == d:  # the bound is the cosine
            sure = bound >= cosine + slack
            alive &= ~sure
        i, j = np.divmod(np.flatnonzero(alive), alive.shape[1])
        for k in range(0, len(i), 200_000):
            p, q = _follow(a, py, i[k : k + 200_000], j[k : k + 200_000], done, cosine)
            v, w = x[lo + p], y[q]
            exact = (v * w).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((w * w).sum(1)))
            sure[p[exact >= cosine], q[exact >= cosine]] = True
        out[lo : lo + BLOCK] = sure
    return out


def _follow(px: np.ndarray, py: np.ndarray, i: np.ndarray, j: np.ndarray, done: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that still may reach the threshold after all coordinates beyond done, step by step."""
    dot = (px[i, :done] * py[j, :done]).sum(1)
    while done < px.shape[1] and len(i):
        dot += (px[i, done : done + STEP] * py[j, done : done + STEP]).sum(1)
        done = min(done + STEP, px.shape[1])
        on = dot + _suffix_norms(px, done)[i] * _suffix_norms(py, done)[j] >= cosine - _SLACK
        i, j, dot = i[on], j[on], dot[on]
    return i, j


KEY = ["ca", "ta", "cb", "tb"]


def _links(turn: np.ndarray, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, g in key_runs(batches, KEY):
            same = key[:2] == key[2:]
            at = [np.flatnonzero(g["side"] == s) for s in (0, 0 if same else 1)]
            if not len(at[0]) or not len(at[1]):
                continue
            ids, copies = [g["rep"][i] for i in at], [g["copies"][i].astype(np.float64) for i in at]
            near = compare(*(_matrix(g["embedding"][i], len(turn)) for i in at), turn, cosine)
            if same:
                near[np.arange(len(near)), np.arange(len(near))] = False
            if not near.any():
                continue
            count = [near @ copies[1], near.T @ copies[0]]
            label = [ids[0].copy(), ids[0 if same else 1].copy()]
            far = np.iinfo(np.int64).max
            while True:
                left = np.minimum(label[0], np.where(near, label[1][None, :], far).min(1))
                right = left if same else np.minimum(label[1], np.where(near, left[:, None], far).min(0))
                if (left == label[0]).all() and (right == label[1]).all():
                    break
                label = [left, right]
            for s in (0,) if same else (0, 1):
                some = np.flatnonzero(count[s] > 0)
                yield pd.DataFrame({"rep": ids[s][some], "links": count[s][some].astype(np.int64), "root": label[s][some]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Two rows are linked if the cosine of their vectors, in doubles, is at least cosine. n_links counts
    the other rows linked directly, copies among them; component_id is the smallest vec_id reachable;
    kept says whether it is the row's own. Null or empty vectors, zero vectors, and vectors with null
    or non-finite components are linked with nothing; so is a null vec_id, whose component is null and
    which isn't kept. Repeated rows are copies. A shorter vector counts as one that ends in zeros, but is no
    copy of that. Other columns are ignored. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = usable_vectors(vectors)
    good = vectors.filter(usable)
    rest = vectors.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = scratch.save(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    turn = rotation(classes)
    if turn is None:
        return rest.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    n = classes.count()
    drawn = classes.orderBy(F.xxhash64("rep", F.lit(29)), "rep").limit(SAMPLE).select("embedding").toPandas()
    depth = int(np.ceil(np.log2(min(CELLS, max(1, n / TILE)))))
    tree = Tree((_unit(_matrix(drawn["embedding"], len(turn))) @ turn)[:, :LEAD], depth)
    element = classes.schema["embedding"].dataType.simpleString()
    celled = scratch.save(classes.mapInPandas(_celled(turn, tree), f"embedding {element}, rep long, copies long, cell int, lead array<double>"), "cells")
    lead = range(min(LEAD, turn.shape[0]))
    boxes = celled.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.array(*[F.min(F.col("lead")[i]) for i in lead]).alias("low"),
        F.array(*[F.max(F.col("lead")[i]) for i in lead]).alias("high"),
        F.array(*[F.avg(F.col("lead")[i]) for i in lead]).alias("centre"),
    )
    off = F.aggregate(F.zip_with("lead", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    balls = celled.join(F.broadcast(boxes.select("cell", "centre")), "cell").groupBy("cell").agg(F.sqrt(F.max(off)).alias("radius"))  # a row a cell
    boxes = boxes.join(balls, "cell").toPandas()
    tiles = dict(zip(boxes["cell"], (-(-boxes["n"] // TILE)).astype(int), strict=True))
    visits = []
    for a, b in near_cells(boxes, cosine):
        visits.append((a, tiles[a], b, tiles[b], a, 0))
        if a != b:
            visits.append((a, tiles[a], b, tiles[b], b, 1))
    # at most CELLS squared rows
    plan = F.broadcast(spark.createDataFrame([tuple(map(int, v)) for v in visits], "ca int, na int, cb int, nb int, cell int, side int"))
    placed = celled.drop("lead").join(plan, "cell")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("na")).otherwise(F.col("nb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("nb")).otherwise(F.col("na")) - 1)
    placed = placed.withColumn("own", own).withColumn("other", F.explode(others))
    inside = F.col("ca") == F.col("cb")
    first = F.when(inside, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    second = F.when(inside, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = F.when(inside, F.when(F.col("own") <= F.col("other"), 0).otherwise(1)).otherwise(F.col("side"))
    dealt = placed.select("ca", first.alias("ta"), "cb", second.alias("tb"), side.alias("side"), "rep", "copies", "embedding")
    found = dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(_links(turn, cosine), "rep long, links long, root long")
    found = scratch.save(found.groupBy("rep", "root").agg(F.sum("links").alias("links")), "links")
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(parts, F.col("rep") == F.col("node"), "left").drop("node")
    rows = good.join(classes, "embedding").join(linked, "rep", "left")
    rows = rows.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
