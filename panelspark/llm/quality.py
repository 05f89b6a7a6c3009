"""Quality classifier: labelled neighbours vote in a latent-semantic space.

Terms of a text are its words, hashed, their shapes, their last signs, and repeats of words just
before. Term frequencies are weighted by the document frequencies of the whole corpus and projected
on the leading singular vectors of a bounded labelled sample. The sample's vectors go to all tasks,
which take exact cosine products in blocks and let the nearest vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lang_id import held_out
from .runtime import ship_code
from .textkit import Words, chunks

#: Bound of the labelled sample, both labels at one rate; latent dimensions; votes; weight of the prior vote.
MAX_ROWS, LATENT, VOTES, PRIOR = 4000, 64, 25, 0.05
THRESHOLD = 0.3
WORD_TERMS, SHAPES, SIGNS, LAGS = 1024, 64, 256, 8
TERMS = WORD_TERMS + SHAPES + SIGNS + LAGS


def term_counts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts (text, term), and the words of each text. None has no words."""
    words = Words(texts)
    n = len(texts)
    count = np.diff(words.first)
    if not len(words.start):
        return np.zeros((n, TERMS), np.float32), count
    h, data = words.hashes(), words.data

    def inside(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[words.end] - total[words.start]

    size = words.end - words.start
    upper = inside((data >= 65) & (data <= 90))
    digit = inside((data >= 48) & (data <= 57))
    sign = inside((data > 32) & (data < 127) & ~(((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))))
    shape = (upper > 0) + 2 * ((upper > 1) & (2 * upper > size)) + 4 * (digit > 0) + 8 * np.minimum(sign, 3) + 32 * (size > 15)
    last = data[words.end - 1]
    base = words.doc * TERMS
    places = [base + (h % np.uint64(WORD_TERMS)).astype(np.int64), base + WORD_TERMS + shape, base + WORD_TERMS + SHAPES + np.where(last < 128, last, 128)]
    for lag in range(1, LAGS + 1):
        at = np.flatnonzero((h[lag:] == h[:-lag]) & (words.doc[lag:] == words.doc[:-lag])) + lag
        places.append(base[at] + WORD_TERMS + SHAPES + SIGNS + lag - 1)
    out = np.zeros(n * TERMS, np.int64)
    for place in places:
        out += np.bincount(place, minlength=n * TERMS)
    return out.reshape(n, TERMS).astype(np.float32), count


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, rows = np.zeros(TERMS, np.int64), 0
    for pdf in batches:
        texts = pdf["text"].tolist()
        for lo, hi in chunks(texts, 1_000_000):
            total += (term_counts(texts[lo:hi])[0] > 0).sum(0)
            rows += hi - lo
    yield pd.DataFrame({"term": np.arange(TERMS + 1), "n": np.append(total, rows)})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((rows + 1) / (rows with the term + 1)) over all of docs."""
    counts = docs.select("text").mapInPandas(_document_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(TERMS + 1)
    n[counts["term"]] = counts["n"]
    return (np.log((n[-1] + 1) / (n[:-1] + 1)) + 0.1).astype(np.float32)


def weighted(texts: list, idf: np.ndarray) -> np.ndarray:
    counts, words = term_counts(texts)
    return np.sqrt(counts / np.maximum(words, 1)[:, None].astype(np.float32)) * idf


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


class Neighbours:
    """Latent vectors of labelled rows, and their votes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, idf: np.ndarray, latent: int = LATENT):
        self.idf, self.labels = idf, y.astype(np.float32)
        self.axes = np.linalg.eigh((x.T @ x).astype(np.float64))[1][:, ::-1][:, :latent].astype(np.float32) if len(x) else np.zeros((TERMS, 1), np.float32)
        self.vectors = _unit(x @ self.axes)
        self.prior = float(y.mean()) if len(y) else 0.5

    def score(self, texts: list, block: int = 512) -> np.ndarray:
        """Votes of the nearest labelled rows; the prior has a small vote and is all that a text without words gets."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(VOTES, len(self.labels))
        for lo, hi in chunks(texts, 1_000_000):
            z = _unit(weighted(texts[lo:hi], self.idf) @ self.axes)
            for a in range(0, hi - lo, block):
                cosine = z[a : a + block] @ self.vectors.T
                near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4
                votes = (weight * self.labels[near]).sum(1)
                out[lo + a : lo + a + len(z[a : a + block])] = (votes + PRIOR * self.prior) / (weight.sum(1) + PRIOR)
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Neighbours:
    """Neighbours from docs (doc_id, text) and labels (doc_id, quality), by rows that aren't held out.

    Up to max_rows rows are drawn by a hash of doc_id, whatever their label, so that votes and prior
    have the labels' own ratio for any number of rows; a row with several labels counts as the largest,
    a null label as none; of a doc_id's texts the least is taken. Term weights are of all rows of docs.
    """
    ship_code(docs.sparkSession)
    known = labels.filter(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.filter(F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows).toPandas()
    idf = inverse_frequencies(docs)
    if not len(sample):
        return Neighbours(np.zeros((0, TERMS), np.float32), np.zeros(0), idf)
    chosen = docs.sparkSession.createDataFrame(sample.astype({"doc_id": "int64", "quality": "int32"}))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts, 1_000_000):
                x = weighted(texts[lo:hi], idf)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo:hi], "quality": pdf["quality"].iloc[lo:hi], "x": [v.tobytes() for v in x]})

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.mapInPandas(vectors, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id")
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]]) if len(rows) else np.zeros((0, TERMS), np.float32)
    return Neighbours(x, rows["quality"].to_numpy(np.float64), idf)


def classify(docs: DataFrame, neighbours: Neighbours) -> DataFrame:
    """docs with held_out, score and predicted (1 from THRESHOLD on).

    A text without words, null or empty, gets the share of label 1 in the sample; without any label
    that is 0.5. Equal texts get equal scores up to rounding. Other columns pass through; columns
    with the three names are replaced. An empty table gives an empty one.
    """
    ship_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(neighbours)  # MAX_ROWS vectors of LATENT coordinates, and the axes

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.score(texts.tolist()))

    scored = docs.withColumn("score", apply(F.col("text")))
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
