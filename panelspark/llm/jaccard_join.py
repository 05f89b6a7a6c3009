"""N-gram Jaccard self-join of documents by chosen paths.

A document is the set of its word n-grams; documents with equal sets are one class. Each set has
TOKENS min-hash tokens: two sets share a token with a probability equal to their similarity. A run
starts from the bucket of one token, and splits a bucket that is too large on sampled further
tokens, the same for all its members, with enough children for similar sets to stay together in
one of them with high probability. Small buckets, and large ones that don't split, are compared
directly, in tiles. The number of runs follows from the target recall.

A pair is compared in one place only, the smallest bucket that both share, so links are counted and
joined to components without listing pairs or removing repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import Scratch
from .streams import key_runs
from .textkit import Words, chunks, mix

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.99999
TOKENS, BRANCH, DEPTH = 32, 2, 3
#: Sets in a bucket, and shingles in it, that are compared at once.
TILE_SETS, TILE_SHINGLES = 1024, 4_000_000
DEAL_BYTES = 8_000_000
_MULTIPLIERS = (np.random.default_rng(5).integers(1, 2**31, TOKENS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def runs_for(recall: float, similarity: float) -> int:
    """Runs so that a pair at the threshold shares a bucket in one of them with the probability recall,
    even if each run splits it DEPTH times. More than TOKENS, one a run, are an error: ask for less recall."""
    stay = 1 - (1 - similarity) ** BRANCH
    runs = math.ceil(math.log(1 - recall) / math.log(1 - similarity * stay**DEPTH)) if similarity < 1 else 1
    if runs > TOKENS:
        raise ValueError(f"recall {recall} at similarity {similarity} takes {runs} runs; at most {TOKENS} can be made")
    return runs


def shingles(texts: list, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, joined, and where each text's begin.

    A text of fewer words than width has one shingle of them all; a text without words has none.
    """
    words = Words(texts, lower=True)
    h = words.hashes()
    full, at = words.windows(h, width)
    count = np.diff(words.first)
    owner = words.doc[at]
    parts, first = [], np.concatenate(([0], np.searchsorted(owner, np.arange(1, len(texts) + 1))))
    sizes = np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        if count[i] >= width:
            own = np.sort(full[first[i] : first[i + 1]])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif count[i]:
            with np.errstate(over="ignore"):
                x = np.uint64(count[i])
                for y in h[words.first[i] : words.first[i + 1]]:
                    x = mix(np.array([x * np.uint64(31) + y]))[0]
            own = np.array([x], np.uint64)
        else:
            continue
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def min_tokens(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """TOKENS min-hash tokens of each non-empty set; a token names the shingle with the least hash."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), TOKENS), np.uint64)
    high, low = (flat >> np.uint64(32)).astype(np.uint32), flat & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for k, a in enumerate(_MULTIPLIERS):
            x = high * a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            out[:, k] = np.minimum.reduceat((x.astype(np.uint64) << np.uint64(32)) | low, starts) if len(starts) else 0
    return out


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
            for lo, hi in chunks(texts):
                flat, first = shingles(texts[lo:hi], width)
                n = np.diff(first)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                tokens = min_tokens(flat, first)
                with np.errstate(over="ignore"):
                    one = np.add.reduceat(mix(flat), first[:-1][has])
                    two = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][has])
                yield pd.DataFrame({"doc_id": ids[lo:hi][has], "n": n[has], "k1": one.view(np.int64), "k2": two.view(np.int64), "tokens": list(tokens.view(np.int64))})

    return run


def _words_matrix(blobs: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of the path numbers in blobs that are smaller than below."""
    values = [np.frombuffer(b, np.int64) for b in blobs]
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    value = np.concatenate(values)
    at = value < below
    return row[at], value[at]


def _shared(row: np.ndarray, value: np.ndarray, m: int, block: int = 4096) -> np.ndarray:
    """How many values each two of m rows have in common; a row has a value once at most."""
    value, at = np.unique(value, return_inverse=True)
    often = np.bincount(at, minlength=len(value)) > 1
    rank = np.cumsum(often) - 1
    keep = often[at]
    row, at = row[keep], rank[at[keep]]
    out = np.zeros((m, m), np.float32)
    for lo in range(0, int(often.sum()), block):
        inside = (at >= lo) & (at < lo + block)
        part = np.zeros((m, min(block, int(often.sum()) - lo)), np.float32)
        part[row[inside], at[inside] - lo] = 1
        out += part @ part.T
    return out


def _comparable(g: dict[str, np.ndarray], path: int, similarity: float) -> np.ndarray:
    """Which pairs of a bucket's tile are this bucket's to compare, and near enough in size."""
    m = len(g["rep"])
    n = g["n"].astype(np.float64)
    ok = np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-9
    if (g["tile"] != g["tile"][0]).any():
        ok &= g["tile"][:, None] != g["tile"][None, :]
    ok &= _shared(*_words_matrix(g["paths"], path), m) == 0
    ok[np.arange(m), np.arange(m)] = False
    return ok


KEY = ["path", "ti", "tj"]


def _candidates(similarity: float):
    """Members of a tile that have a likely partner there: enough equal min-hash tokens."""
    least = math.floor(TOKENS * max(0.0, similarity - 4.3 * math.sqrt(similarity * (1 - similarity) / TOKENS)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        size = 0
        for key, g in key_runs(batches, KEY):
            if key[1] != key[2] and (g["tile"] == g["tile"][0]).all():
                continue
            ok = _comparable(g, key[0], similarity)
            if not ok.any():
                continue
            tokens = np.stack(g["tokens"])
            same = np.zeros(ok.shape, np.int16)
            for k in range(TOKENS):
                same += tokens[:, k][:, None] == tokens[:, k][None, :]
            at = np.flatnonzero((ok & (same >= least)).any(1))
            if len(at):
                out.append(pd.DataFrame({"path": key[0], "ti": key[1], "tj": key[2], "tile": g["tile"][at], "rep": g["rep"][at]}))
                size += len(at)
            if size > 20_000:
                yield pd.concat(out)
                out, size = [], 0
        if out:
            yield pd.concat(out)

    return run


def _deal(width: int):
    """The shingles of a document for each tile that compares it, about DEAL_BYTES at once."""
    columns = [*KEY, "tile", "rep", "copies", "n", "paths", "shingles"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts, 500_000):
                flat, first = shingles(texts[lo:hi], width)
                rows, size = [], 0
                for i, (rep, copies, paths, places) in enumerate(pdf[["rep", "copies", "paths", "places"]].iloc[lo:hi].itertuples(index=False)):
                    own = flat[first[i] : first[i + 1]].tobytes()
                    for p in places:
                        rows.append((p["path"], p["ti"], p["tj"], p["tile"], rep, copies, len(own) // 8, paths, own))
                        size += len(own) + len(paths)
                        if size > DEAL_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def _links(similarity: float):
    """For each member of a tile with links there: how many documents, and the smallest of its local component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, g in key_runs(batches, KEY):
            if len(np.unique(g["rep"])) < len(g["rep"]):  # repeated rows of one document
                at = list({(r, b): i for i, (r, b) in enumerate(zip(g["rep"], g["shingles"], strict=True))}.values())
                g = {c: v[at] for c, v in g.items()}
            if len(g["rep"]) < 2:
                continue
            ok = _comparable(g, key[0], similarity)
            if not ok.any():
                continue
            sets = [np.frombuffer(b, np.uint64) for b in g["shingles"]]
            n = g["n"].astype(np.float64)
            if len(sets) == 2:
                both = np.sort(np.concatenate(sets))
                shared = np.full((2, 2), float((both[1:] == both[:-1]).sum()))
            else:
                shared = _shared(np.repeat(np.arange(len(sets)), g["n"]), np.concatenate(sets), len(sets))
            near = ok & (shared >= similarity * (n[:, None] + n[None, :] - shared) - 1e-9)
            links = near @ g["copies"].astype(np.float64)
            label = g["rep"].copy()
            while True:
                least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
                if (least == label).all():
                    break
                label = least
            at = np.flatnonzero(near.any(1))
            out += zip(g["rep"][at], links[at].astype(np.int64), label[at], strict=True)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["rep", "links", "root"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["rep", "links", "root"])

    return run


def _buckets(reps: DataFrame, runs: int, scratch: Scratch) -> DataFrame:
    """(path, c, s, rep): the buckets to compare, with their numbers of sets and of shingles."""

    def sized(paths: DataFrame, name: str) -> DataFrame:
        sizes = paths.groupBy("path").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter("c > 1")
        return paths.join(scratch.save(sizes, f"sizes-{name}"), "path")

    large = (F.col("c") > TILE_SETS) | (F.col("s") > TILE_SHINGLES)
    roots = reps.select("rep", "n", F.posexplode(F.slice("tokens", 1, runs)).alias("run", "token"))
    live = sized(roots.select(F.xxhash64("run", "token").alias("path"), "rep", "n", F.lit(2**62).alias("parent")), "0")
    leaves = []
    for depth in range(1, DEPTH + 1):
        split = large & (F.col("c") <= F.col("parent") / 2)
        live = scratch.save(live, f"live-{depth}")
        leaves.append(live.filter(~split).select("path", "c", "s", "rep"))
        big = live.filter(split)
        if big.isEmpty():
            return leaves[0] if depth == 1 else _union(leaves)
        child = F.explode(F.array(*[F.pmod(F.xxhash64("path", F.lit(b)), F.lit(TOKENS)).cast("int") for b in range(BRANCH)])).alias("at")
        grown = big.select("path", "rep", "n", F.col("c").alias("parent"), child).distinct().join(reps.select("rep", "tokens"), "rep")
        live = sized(grown.select(F.xxhash64("path", "at", F.element_at("tokens", F.col("at") + 1)).alias("path"), "rep", "n", "parent"), str(depth))
    return _union([*leaves, live.select("path", "c", "s", "rep")])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def jaccard_join(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of lower-case word n-grams is
    at least similarity. n_links counts the other rows linked directly, copies among them; class_id
    is the smallest doc_id reachable by links. A document of fewer than width words has one n-gram
    of them all. Null, empty and blank texts have no n-grams and no links. A null doc_id is linked
    with nothing and keeps a null class. Repeated rows are copies of each other; a doc_id with
    several texts is one document with the links of each; its rows without words have none. Other columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sets = scratch.save(known.mapInPandas(_sketch(width), "doc_id long, n long, k1 long, k2 long, tokens array<long>"), "sets")
    classes = sets.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))
    reps = scratch.save(classes, "reps")
    member = sets.select("doc_id", "k1", "k2", "n").join(reps.select("k1", "k2", "n", "rep", "copies"), ["k1", "k2", "n"]).select("doc_id", "rep", "copies")

    leaves = scratch.save(_buckets(reps, runs_for(recall, similarity), scratch), "leaves")
    paths = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    as_bytes = F.pandas_udf(lambda s: s.map(lambda v: np.asarray(v, np.int64).tobytes()), "binary")
    held = scratch.save(reps.join(paths, "rep").select("rep", "n", "copies", "tokens", as_bytes("paths").alias("paths")), "held")

    tiles = F.ceil(F.greatest(F.col("c") / TILE_SETS, F.col("s") / TILE_SHINGLES)).cast("int")
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    placed = leaves.withColumn("tiles", F.greatest(tiles, F.lit(1))).withColumn("tile", tile)
    placed = placed.select("path", "rep", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    placed = placed.select("path", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "rep")
    dealt = placed.join(held.drop("copies"), "rep").repartition(*KEY).sortWithinPartitions(*KEY)
    likely = dealt.mapInPandas(_candidates(similarity), "path long, ti int, tj int, tile int, rep long")
    places = scratch.save(likely.groupBy("rep").agg(F.collect_list(F.struct(*KEY, "tile")).alias("places")), "places")

    wanted = places.join(held.select("rep", "copies", "paths"), "rep")
    full = known.join(wanted, known.doc_id == wanted.rep).select("text", "rep", "copies", "paths", "places")
    shown = full.mapInPandas(_deal(width), "path long, ti int, tj int, tile int, rep long, copies long, n long, paths binary, shingles binary")
    found = shown.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(_links(similarity), "rep long, links long, root long")
    found = scratch.save(found.groupBy("rep", "root").agg(F.sum("links").alias("links")), "links")

    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(parts, F.col("rep") == F.col("node"), "left").drop("node")
    rows = member.join(linked, "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    wordless = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rest = docs.filter(wordless).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.unionByName(rest)
