"""Exact top-k search by inner product with a pivot-distance index.

A vector's key is its nearest pivot and its distance to it. Since q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2
and |q-x| >= |d(q,p) - d(x,p)|, the vectors of an annulus around a pivot p have a bound on their
score from the annulus' distances and largest norm alone. Neighbouring pivots make groups of bounded
size. A query first searches the group where its bound is largest; with the k-th best score so found
it enters the other groups whose bounds may reach it, once each, and expands the sorted annuli there
from the largest bound on, until no bound can reach it. All arithmetic on scores is in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch
from .streams import key_runs

K, SCALE = 5, 256
#: Bound of the sample from which pivots and first thresholds come; pivots are the square root of the rows, at most so many.
SAMPLE, PIVOTS = 4096, 1024
#: Rows of a group, of an annulus, and queries that are scored at once.
GROUP, ANNULUS, QUERIES = 65_536, 1024, 512
#: Slack for the rounding of distances, which are doubles of integers' square roots.
_SLACK = 1e-6
#: Below any score, and its negative is an integer too.
_NONE = -(2**62)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * component) of each vector without null or non-finite components, as longs."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


class Layout:
    """How vectors are written in bytes: all of one length, in the smallest integers that hold them."""

    def __init__(self, length: int, largest: int):
        self.length = length
        self.kind = next(f"<i{n}" for n in (2, 4, 8) if largest < 2 ** (8 * n - 1) or n == 8)
        #: Whether doubles hold every score, and every part of it, exactly.
        self.exact = float(largest) ** 2 * max(length, 1) < 2**52

    def matrix(self, arrays) -> np.ndarray:
        """Rows of the given arrays, those that are shorter ending in zeros."""
        out = np.zeros((len(arrays), self.length), np.float64 if self.exact else np.int64)
        for i, a in enumerate(arrays):
            out[i, : len(a)] = a
        return out

    def pack(self, x: np.ndarray) -> list[bytes]:
        return [row.tobytes() for row in x.astype(self.kind)]

    def unpack(self, blobs) -> np.ndarray:
        x = np.frombuffer(b"".join(blobs), self.kind).reshape(len(blobs), self.length)
        return x.astype(np.float64 if self.exact else np.int64)


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = 4) -> np.ndarray:
    """Means of clusters of the sample, begun from rows far from each other."""
    x = sample.astype(np.float64)
    centre = [x[0]]
    far = ((x - centre[0]) ** 2).sum(1)
    while len(centre) < min(pivots, len(x)) and far.max(initial=0) > 0:
        centre.append(x[far.argmax()])
        far = np.minimum(far, ((x - centre[-1]) ** 2).sum(1))
    p = np.array(centre)
    for _ in range(rounds):
        near = _distances(x, p).argmin(1)
        p = np.array([x[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))


def _keyed(pivots: np.ndarray, layout: Layout):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = layout.matrix(pdf["v"])
                d = _distances(x, pivots)
                near = d.argmin(1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "pivot": near, "distance": d[np.arange(len(d)), near], "norm": (x.astype(np.float64) ** 2).sum(1), "x": layout.pack(x)})

    return run


def _bound(qnorm: np.ndarray, qd: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The largest score that a query may have with a vector of norm squared <= norm in an annulus."""
    gap = np.maximum(0, np.maximum(low - qd, qd - high) - _SLACK)
    return (qnorm + norm - gap * gap) / 2 + _SLACK * (qnorm + norm + 1)


def make_groups(cells: pd.DataFrame, pivots: np.ndarray, size: int) -> pd.DataFrame:
    """cells (pivot, n, ...) with first and parts: the groups that a pivot's rows are dealt to, parts of them from
    first on. Neighbours along the pivots' main direction share a group as long as it has no more than size rows."""
    own = pivots[cells["pivot"]]
    main = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][0] if own.size else np.zeros(own.shape[1])
    first, parts = np.zeros(len(cells), int), np.ones(len(cells), int)
    group, held = 0, 0
    for i in np.argsort(own @ main, kind="stable"):
        n = int(cells["n"].iloc[i])
        if held and held + n > size:
            group, held = group + 1, 0
        first[i], parts[i] = group, -(-n // size)
        held += n
        if parts[i] > 1:
            group, held = group + parts[i], 0
    return cells.assign(first=first, parts=parts)


def _visits(pivots: np.ndarray, cells: pd.DataFrame, layout: Layout, sample_ids: np.ndarray, sample: np.ndarray, k: int, home: bool):
    """(group, vec_id, least, x): of each query its home, the group with the largest bound; or the others that may
    hold one of its k best. least: a score that these have at least, of the sample, or as given if that is more."""
    low, high, norm = (cells[c].to_numpy(np.float64) for c in ("low", "high", "norm"))
    at, first, parts = (cells[c].to_numpy() for c in ("pivot", "first", "parts"))
    cell = np.repeat(np.arange(len(cells)), parts)  # of each (cell, group)
    group = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), QUERIES):
                pdf = whole.iloc[lo : lo + QUERIES]
                q, ids = layout.matrix(pdf["v"]), pdf["vec_id"].to_numpy()
                score = np.where(ids[:, None] == sample_ids[None, :], _NONE, (q @ sample.T).astype(np.int64))
                least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(q), _NONE)
                least = np.maximum(least, pdf["least"].to_numpy(np.int64))
                bound = _bound((q.astype(np.float64) ** 2).sum(1)[:, None], _distances(q, pivots)[:, at], low, high, norm)
                best = np.full((len(q), group.max() + 1), -np.inf)
                np.maximum.at(best, (slice(None), group), bound[:, cell])
                own = best.argmax(1)
                chosen = best >= least[:, None]
                chosen[np.arange(len(q)), own] = False
                row, to = (np.arange(len(q)), own) if home else np.nonzero(chosen)
                blobs = np.array(layout.pack(q), object)
                yield pd.DataFrame({"group": to, "vec_id": ids[row], "least": least[row], "x": blobs[row]})

    return run


class _Group:
    """Rows around a few pivots, sorted by pivot and distance, in annuli."""

    def __init__(self, g: dict[str, np.ndarray], pivots: np.ndarray, layout: Layout):
        order = np.lexsort((g["distance"], g["pivot"]))
        pivot, d = g["pivot"][order], g["distance"][order]
        self.ids, self.x = g["vec_id"][order], layout.unpack(g["x"][order])
        edge = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
        cut = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(edge, np.append(edge[1:], len(d)), strict=True)])
        self.cut = np.append(cut, len(d))
        self.low, self.high = d[cut], d[self.cut[1:] - 1]
        self.norm = np.maximum.reduceat(g["norm"][order], cut)
        self.pivots, self.ring_pivot = pivots[pivot[edge]], np.searchsorted(edge, cut, side="right") - 1

    def search(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> pd.DataFrame:
        """The k best rows of the group for each query, as far as they may be among the k best of all."""
        least = least.copy()
        qnorm = (q.astype(np.float64) ** 2).sum(1)
        bound = _bound(qnorm[:, None], _distances(q, self.pivots)[:, self.ring_pivot], self.low, self.high, self.norm)
        held = [np.zeros(0, np.int64)] * 3  # query, vec_id, score
        more: list[tuple] = []

        def settle() -> None:
            nonlocal held
            who, what, score = (np.concatenate(x) for x in zip(held, *more, strict=True))
            more.clear()
            order = np.lexsort((what, -score, who))
            who, what, score = who[order], what[order], score[order]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))[: len(who)]
            place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            last = np.flatnonzero(place == k - 1)
            least[who[last]] = np.maximum(least[who[last]], score[last])
            held = [x[place < k] for x in (who, what, score)]

        for r in np.argsort(-bound.max(0), kind="stable"):
            live = np.flatnonzero(bound[:, r] >= least)
            if not len(live):
                continue
            part = slice(self.cut[r], self.cut[r + 1])
            score = (q[live] @ self.x[part].T).astype(np.int64)
            i, j = np.nonzero((score >= least[live][:, None]) & (ids[live][:, None] != self.ids[part][None, :]))
            more.append((live[i], self.ids[part][j], score[i, j]))
            if sum(len(x[0]) for x in more) > 10 * k * len(ids):
                settle()
        if more:
            settle()
        return pd.DataFrame({"query_id": ids[held[0]], "vec_id": held[1], "score": held[2]})


def _expand(pivots: np.ndarray, layout: Layout, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at = None, None
        for key, g in key_runs(batches, ["group", "kind", "piece"]):
            if key[0] != at:
                group, at = None, key[0]
            if key[1] == 0:
                group = _Group(g, pivots, layout)
            elif group is not None:
                for lo in range(0, len(g["vec_id"]), QUERIES):
                    s = slice(lo, lo + QUERIES)
                    yield group.search(g["vec_id"][s], layout.unpack(g["x"][s]), g["least"][s], k)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries the k rows of vectors with the largest scores.

    Both have vec_id and embedding. The score is the inner product of floor(256 * component), as an
    integer; ties go to the smaller vec_id, and rows with the query's own vec_id are no candidates. With
    fewer than k candidates all are returned. Rows with a null vec_id or vector, or with null or
    non-finite components, take no part. A shorter vector, the empty one too, counts as one that ends in
    zeros. A repeated row is a candidate each time; a repeated query is asked once, of differing ones the
    least. Other columns are ignored. Empty tables give an empty result.

    Pivots and first thresholds come from a sample of SAMPLE rows at most; every row is indexed and
    the result is exact. A group has GROUP rows at most, but for rounding: a pivot with more is dealt into several.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    whole = whole_vectors(vectors)
    asked = whole_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = F.max(F.size("v")).alias("length")
    most = F.max(F.array_max(F.transform("v", F.abs))).alias("largest")
    sizes = whole.agg(F.count("*").alias("n"), size, most).unionByName(asked.agg(F.count("*").alias("n"), size, most)).collect()
    if not sizes[0]["n"] or not sizes[1]["n"]:
        return spark.createDataFrame([], schema)
    layout = Layout(max(s["length"] for s in sizes), max(s["largest"] or 0 for s in sizes))
    drawn = whole.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id", "v").limit(SAMPLE).toPandas()
    sample_ids, sample = drawn["vec_id"].to_numpy(), layout.matrix(drawn["v"])
    pivots = choose_pivots(sample, min(PIVOTS, max(16, round(sizes[0]["n"] ** 0.5))))
    index = scratch.save(whole.mapInPandas(_keyed(pivots, layout), "vec_id long, pivot int, distance double, norm double, x binary"), "index")
    cells = index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm")).toPandas()
    cells = make_groups(cells, pivots, GROUP)
    # a row a pivot, PIVOTS at most
    dealt = F.broadcast(spark.createDataFrame(cells[["pivot", "first", "parts"]].astype(int), "pivot int, first int, parts int"))
    group = (F.col("first") + F.pmod(F.xxhash64("vec_id", "x"), F.col("parts"))).cast("int")
    nothing = F.lit(0).cast("long")
    rows = index.join(dealt, "pivot").select(group.alias("group"), F.lit(0).alias("kind"), F.lit(0).alias("piece"), "vec_id", "pivot", "distance", "norm", nothing.alias("least"), "x")
    zero = F.lit(0.0)

    def search(questions: DataFrame, home: bool) -> DataFrame:
        visits = questions.mapInPandas(_visits(pivots, cells, layout, sample_ids, sample, k, home), "group int, vec_id long, least long, x binary")
        piece = F.pmod(F.xxhash64("vec_id"), F.lit(1024)).cast("int")
        visits = visits.select("group", F.lit(1).alias("kind"), piece.alias("piece"), "vec_id", F.lit(0).alias("pivot"), zero.alias("distance"), zero.alias("norm"), "least", "x")
        both = rows.unionByName(visits).repartition("group").sortWithinPartitions("group", "kind", "piece")
        return both.mapInPandas(_expand(pivots, layout, k), "query_id long, vec_id long, score long")

    near = scratch.save(search(asked.withColumn("least", F.lit(_NONE)), True), "home")
    reached = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    again = asked.join(reached, "vec_id", "left").select("vec_id", "v", F.coalesce("least", F.lit(_NONE)).alias("least"))
    found = near.unionByName(search(again, False))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
