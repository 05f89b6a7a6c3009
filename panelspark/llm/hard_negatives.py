"""Hard negatives: near misses of other labels, in windows below an anchor's positives.

Candidates are sorted along a Hilbert curve and written as Parquet, a row group a block of neighbours,
with the least and the largest of every dimension in the block: its zone map. The inner product of an
anchor with any row of a block lies between the sums, over the dimensions, of the smaller and of the
larger of anchor times least and anchor times largest. An anchor's searches are windows of scores: for its
positives from its k-th best score on, for its negatives between two parts of a positive's score. It goes
to the runs of blocks, and there reads only the blocks, whose intervals meet its windows. Scores are
exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch
from .store import located, unescaped
from .streams import key_runs
from .topk import Layout

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is between these per cents of the positive's.
WINDOW = (50, 95)
#: Rows of a block; rows of a run of blocks at least, unless the table is small; runs at most; anchors searched at once.
BLOCK, RUN, RUNS, ANCHORS = 1024, 65_536, 4096, 256
#: Runs of a small table, as far as it has blocks; anchors of a task, about.
SPREAD, PIECE = 32, 65_536
#: Rows of the sample that the curve is fitted on at most; dimensions and bits of the curve.
SAMPLE, CURVE = 4096, (6, 10)
#: Bytes of blocks that a task keeps.
CACHE = 64 << 20
_NONE = -(2**62)


def whole_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): floor(SCALE * component) of each row with a label and a whole vector, as longs."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    usable = usable & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates of so many bits, a row a point.

    The curve's quadrants are turned in the coordinates' own bits, from the highest on: where a coordinate has the bit
    the first coordinate's lower bits are flipped, else they change places with its own. What is left is a Gray
    code whose bits are the coordinates' in turn."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        lower = (1 << bit) - 1
        for d in range(dims):
            has = (x[d] >> bit & 1).astype(bool)
            swapped = np.where(has, 0, (x[0] ^ x[d]) & lower)
            x[0] ^= np.where(has, lower, swapped)
            x[d] ^= swapped
    place, parity = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            parity ^= x[d] >> bit & 1
            place = place << 1 | parity
    return place


class Curve:
    """Hilbert places of vectors by their most varying dimensions, each cut into cells of one width between the sample's bounds."""

    def __init__(self, sample: np.ndarray, dims: int = CURVE[0], bits: int = CURVE[1]):
        x = sample.astype(np.float64)
        self.bits = bits
        self.at = np.argsort(-x.var(0), kind="stable")[:dims]
        self.low, high = np.quantile(x[:, self.at], [0.002, 0.998], axis=0)
        self.width = np.where(high > self.low, high - self.low, 1.0)

    def places(self, x: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.zeros(len(x), np.int64)
        cells = (x[:, self.at] - self.low) / self.width * (1 << self.bits)
        return hilbert(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def _keyed(curve: Curve, layout: Layout):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = layout.matrix(pdf["v"])
                yield pd.DataFrame({"place": curve.places(x), "vec_id": pdf["vec_id"], "label": pdf["label"], "x": layout.pack(x)})

    return run


_BLOCKS = "run int, n int, low binary, high binary, first_label long, last_label long, ids binary, labels binary, x binary"


def _blocks(layout: Layout):
    """Blocks of a sorted partition's rows, each with its zone map."""

    def block(held: pd.DataFrame) -> tuple:
        x = layout.unpack(list(held["x"]))
        label = held["label"].to_numpy(np.int64)
        low, high = (f(0).astype(np.int64).tobytes() for f in (x.min, x.max))
        return TaskContext.get().partitionId(), len(x), low, high, label.min(), label.max(), held["vec_id"].to_numpy(np.int64).tobytes(), label.tobytes(), b"".join(held["x"])

    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= BLOCK:
                whole = pd.concat(held, ignore_index=True)
                held = [whole.iloc[BLOCK:]]
                yield pd.DataFrame([block(whole.iloc[:BLOCK])], columns=names)
        if sum(map(len, held)):
            yield pd.DataFrame([block(pd.concat(held, ignore_index=True))], columns=names)

    return run


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that each row of q may have with a vector between low and high, with
    slack for rounding."""
    q = q.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


class Zones:
    """Zone maps of runs of blocks: where each is, and the bounds of its rows."""

    def __init__(self, found: pd.DataFrame):
        self.path = [unescaped(p) for p in found["path"]]
        self.low, self.high = (np.array([np.frombuffer(b, np.int64) for b in found[c]], np.float64) for c in ("low", "high"))
        self.first, self.last = (found[c].to_numpy(np.int64) for c in ("first_label", "last_label"))


def _union(pdf: pd.DataFrame) -> pd.DataFrame:
    low, high = (f([np.frombuffer(b, np.int64) for b in pdf[c]], axis=0).tobytes() for f, c in ((np.min, "low"), (np.max, "high")))
    return pd.DataFrame({"path": pdf["path"].iloc[:1], "low": [low], "high": [high], "first_label": [pdf["first_label"].min()], "last_label": [pdf["last_label"].max()]})


class _Run:
    """A run's blocks: their zone maps, and their rows as they are needed."""

    def __init__(self, path: str, layout: Layout):
        import pyarrow.parquet as pq

        files, at = located(path)
        self.file, self.layout = pq.ParquetFile(files.open_input_file(at)), layout
        maps = self.file.read(columns=["n", "low", "high", "first_label", "last_label"]).to_pandas()
        zones = Zones(maps.assign(path=path))
        self.low, self.high, self.first, self.last, self.n = zones.low, zones.high, zones.first, zones.last, maps["n"].to_numpy()
        meta = self.file.metadata
        self.stop = np.cumsum([meta.row_group(i).num_rows for i in range(meta.num_row_groups)])
        self.kept: dict[int, tuple] = {}
        self.size = 0

    def rows(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, labels, x) of a block."""
        if block not in self.kept:
            group = int(np.searchsorted(self.stop, block, side="right"))
            inside = block - (int(self.stop[group - 1]) if group else 0)
            part = {c: v[inside] for c, v in self.file.read_row_group(group, columns=["ids", "labels", "x"]).to_pydict().items()}
            x = np.frombuffer(part["x"], self.layout.kind).reshape(-1, self.layout.length)
            while self.kept and self.size > CACHE:
                self.size -= self.kept.pop(next(iter(self.kept)))[2].nbytes
            self.kept[block] = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["labels"], np.int64), x
            self.size += x.nbytes
        ids, labels, x = self.kept[block]
        return ids, labels, x.astype(np.float64 if self.layout.exact else np.int64)


class _Best:
    """The k best (score, then smaller id) of each slot."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.slot, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.more: list[tuple] = []

    def add(self, slots: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """score: slots x ids, _NONE where a row is not allowed; those below a slot's least are left out."""
        score = np.where(score >= self.least[slots][:, None], score, _NONE)
        if score.shape[1] > self.k:
            score = np.where(score >= np.partition(score, -self.k, axis=1)[:, -self.k][:, None], score, _NONE)
        i, j = np.nonzero(score > _NONE)
        self.more.append((slots[i], ids[j], score[i, j]))
        if sum(len(x[0]) for x in self.more) > 10 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        slot, id_, score = (np.concatenate(x) for x in zip((self.slot, self.id, self.score), *self.more, strict=True))
        self.more = []
        order = np.lexsort((id_, -score, slot))
        slot, id_, score = slot[order], id_[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))[: len(slot)]
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        full = np.flatnonzero(place == self.k - 1)
        self.least[slot[full]] = np.maximum(self.least[slot[full]], score[full])
        self.slot, self.id, self.score = (v[place < self.k] for v in (slot, id_, score))


def _find_positives(run: _Run, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> pd.DataFrame:
    """The run's k best rows of each anchor's label, as far as they reach least."""
    _, bound = intervals(q, run.low, run.high)
    bound[(labels[:, None] < run.first) | (labels[:, None] > run.last)] = -np.inf
    best = _Best(least, k)
    for b in np.argsort(-bound.max(0), kind="stable"):
        live = np.flatnonzero(bound[:, b] >= best.least)
        if len(live):
            rid, rlabel, x = run.rows(b)
            score = (q[live] @ x.T).astype(np.int64)
            best.add(live, rid, np.where((labels[live][:, None] == rlabel) & (ids[live][:, None] != rid), score, _NONE))
            best.settle()
    return pd.DataFrame({"anchor_id": ids[best.slot], "positive_id": best.id, "score": best.score})


def score_windows(positive: np.ndarray, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score s with low * p <= 100 s <= high * p, of each positive's score p."""
    return -((-window[0] * positive) // 100), (window[1] * positive) // 100


def _find_negatives(run: _Run, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> pd.DataFrame:
    """The run's k best rows of other labels in each window (its anchor's place, least and largest score)."""
    below, above = intervals(q, run.low, run.high)
    same = (labels[:, None] == run.first) & (run.first == run.last)
    above[same] = -np.inf
    best = _Best(low, k)
    for b in np.argsort(-above.max(0), kind="stable"):
        live = np.flatnonzero((above[owner, b] >= best.least) & (below[owner, b] <= high))
        if len(live):
            rid, rlabel, x = run.rows(b)
            who, back = np.unique(owner[live], return_inverse=True)
            score = np.where((labels[who][:, None] != rlabel) & (ids[who][:, None] != rid), (q[who] @ x.T).astype(np.int64), _NONE)[back]
            best.add(live, rid, np.where(score <= high[live][:, None], score, _NONE))
            best.settle()
    return pd.DataFrame({"slot": best.slot, "negative_id": best.id, "score": best.score})


def _visits(zones: Zones, layout: Layout, way: str, pieces: int):
    """Anchors with the runs that they search: way home, the one run with the largest bound for positives; others, those
    that may reach their least score; windows, those whose interval meets one of their windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), ANCHORS):
                pdf = whole.iloc[at : at + ANCHORS]
                q, label = layout.unpack(list(pdf["x"])), pdf["label"].to_numpy(np.int64)
                below, above = intervals(q, zones.low, zones.high)
                if way == "windows":
                    met = np.zeros(above.shape, bool)
                    for j, blob in enumerate(pdf["scores"]):
                        low, high = score_windows(np.frombuffer(blob, np.int64), WINDOW)
                        met[j] = ((above[j] >= low[:, None]) & (below[j] <= high[:, None]) & (low <= high)[:, None]).any(0)
                    met &= ~((label[:, None] == zones.first) & (zones.first == zones.last))
                else:
                    above[(label[:, None] < zones.first) | (label[:, None] > zones.last)] = -np.inf
                    home = above.argmax(1)
                    met = above >= pdf["least"].to_numpy()[:, None]
                    met[np.arange(len(pdf)), home] = False
                    if way == "home":
                        met = np.zeros(above.shape, bool)
                        met[np.arange(len(pdf)), home] = True
                row, to = np.nonzero(met)
                yield pdf.iloc[row].assign(run=to, piece=pdf["vec_id"].to_numpy()[row] // 50 % pieces)

    return run


def _searched(zones: Zones, layout: Layout, k: int, negatives: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, blocks = None, None
        for key, g in key_runs(batches, ["run", "piece", "batch"]):
            if key[0] != at:
                at, blocks = key[0], _Run(zones.path[key[0]], layout)
            for lo in range(0, len(g["vec_id"]), ANCHORS):
                s = slice(lo, lo + ANCHORS)
                ids, labels, q = g["vec_id"][s], g["label"][s], layout.unpack(list(g["x"][s]))
                if not negatives:
                    yield _find_positives(blocks, ids, labels, q, g["least"][s], k)
                    continue
                names, scores = ([np.frombuffer(b, np.int64) for b in g[c][s]] for c in ("positives", "scores"))
                owner = np.repeat(np.arange(len(ids)), [len(x) for x in names])
                place = np.concatenate([np.arange(len(x)) for x in names])
                names, scores = np.concatenate(names), np.concatenate(scores)
                found = _find_negatives(blocks, ids, labels, q, owner, *score_windows(scores, WINDOW), k)
                slot = found.pop("slot").to_numpy()
                yield found.assign(anchor_id=ids[owner[slot]], place=place[slot], positive_id=names[slot], positive_score=scores[slot])

    return run


def _packed_positives(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["score", "positive_id"], ascending=[False, True])
    return pd.DataFrame({"vec_id": pdf["anchor_id"].iloc[:1], "positives": [pdf["positive_id"].to_numpy(np.int64).tobytes()], "scores": [pdf["score"].to_numpy(np.int64).tobytes()]})


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of anchors and each of its
    positives, the first negatives from the largest score on.

    Both tables have vec_id, label and embedding. A score is the inner product of floor(256 * component) with the
    anchor's, as an integer; ties go to the smaller vec_id. Positives are the first rows of the anchor's label, negatives
    rows of other labels whose score is between the per cents of WINDOW of the positive's score; a negative score has no such
    rows. Fewer are returned if there are no more. Rows with the anchor's own vec_id are no candidates.

    Rows with a null vec_id, label or vector, or with null or non-finite components, take no part. A shorter vector, the
    empty one too, counts as one that ends in zeros. A repeated row is a candidate each time; a repeated anchor is asked
    once, of differing ones the least. Other columns are ignored. Empty tables give an empty result.

    The curve's dimensions and cells come from a sample of SAMPLE rows at most; every row is indexed and the result is
    exact. The zone maps of the runs, RUNS at most, go to every task; those of blocks are read where their run is searched.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    whole = whole_rows(rows)
    asked = whole_rows(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    size, most = F.max(F.size("v")).alias("length"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")
    sizes = whole.agg(F.count("*").alias("n"), size, most).unionByName(asked.agg(F.count("*").alias("n"), size, most)).collect()
    n, n_anchors = sizes[0]["n"], sizes[1]["n"]
    if not n or not n_anchors or not max(s["length"] or 0 for s in sizes):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    layout = Layout(max(s["length"] for s in sizes), max(s["largest"] or 0 for s in sizes))
    drawn = whole.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id", "v").limit(SAMPLE).toPandas()
    curve = Curve(layout.matrix(drawn["v"]))
    runs = min(max(-(-n // RUN), min(-(-n // BLOCK), SPREAD)), RUNS)
    keyed = whole.mapInPandas(_keyed(curve, layout), "place long, vec_id long, label long, x binary")
    keyed = keyed.repartitionByRange(runs, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    index = scratch.save(keyed.mapInPandas(_blocks(layout), _BLOCKS), "blocks", **{"parquet.block.row.count.limit": "1"})
    maps = index.select(F.col("_metadata.file_path").alias("path"), "low", "high", "first_label", "last_label")
    zones = Zones(maps.groupBy("path").applyInPandas(_union, "path string, low binary, high binary, first_label long, last_label long").toPandas().sort_values("path"))
    pieces = -(-n_anchors // PIECE)
    tasks = min(len(zones.path) * pieces, RUNS)

    def search(questions: DataFrame, way: str, fields: str, result: str, k: int) -> DataFrame:
        met = questions.mapInPandas(_visits(zones, layout, way, pieces), f"vec_id long, label long, x binary, {fields}, run int, piece int")
        met = met.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).cast("int"))
        met = met.repartition(tasks, "run", "piece").sortWithinPartitions("run", "piece", "batch")
        return met.mapInPandas(_searched(zones, layout, k, way == "windows"), result)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(v=layout.pack(layout.matrix(pdf["v"]))).rename(columns={"v": "x"})

    asked = scratch.save(asked.mapInPandas(packed, "vec_id long, label long, x binary"), "anchors")
    nothing = F.lit(_NONE).cast("long")
    likes = "anchor_id long, positive_id long, score long"
    near = scratch.save(search(asked.withColumn("least", nothing), "home", "least long", likes, positives), "home")
    reached = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    again = asked.join(reached, "vec_id", "left").select("vec_id", "label", "x", F.coalesce("least", nothing).alias("least"))
    found = near.unionByName(search(again, "others", "least long", likes, positives))
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    found = scratch.save(found.withColumn("place", place).filter(F.col("place") <= positives).drop("place"), "positives")
    given = found.groupBy("anchor_id").applyInPandas(_packed_positives, "vec_id long, positives binary, scores binary")
    misses = search(asked.join(given, "vec_id"), "windows", "positives binary, scores binary", "anchor_id long, place int, positive_id long, positive_score long, negative_id long, score long", negatives)
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "negative_id"))
    out = misses.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
