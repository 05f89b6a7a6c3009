"""Language ID: a convolutional network over bytes, trained in NumPy, applied to fixed-length windows.

One-hot bytes make a filter of width w a sum of w table rows, so tables for byte pairs serve the
widths 2, 3 and 4. Max pooling over a window, a rectifier and a softmax layer follow. A document
gets the mean of its windows' log-probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import fresh, ship_code
from .textkit import chunks, mix

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bound of the training sample, in windows.
MAX_ROWS = 12_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def held_out() -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5. True for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def cut_windows(parts: list[bytes], window: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of windows that cover all the bytes of the joined parts; neighbours overlap."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    n = np.maximum(1, -(-(size - overlap) // (window - overlap)))
    doc = np.repeat(np.arange(len(parts)), n)
    base = np.concatenate(([0], np.cumsum(size)))
    start = base[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * (window - overlap)
    return start, np.minimum(start + window, base[doc + 1]), doc


def gather_windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW) -> np.ndarray:
    place = start[:, None] + np.arange(window)
    return np.where(place < end[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)


def _drawn(share: dict[str, float]):
    """Windows of whole texts that a hash of row and place draws, at the share of their language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, langs, keys = pdf["text"].tolist(), pdf["lang"].tolist(), pdf["key"].to_numpy().view(np.uint64)
            for lo, hi in chunks(texts, 1_000_000):
                parts = [t.encode("utf-8", "replace") for t in texts[lo:hi]]
                start, end, doc = cut_windows(parts)
                with np.errstate(over="ignore"):
                    draw = mix(keys[lo:hi][doc] + np.arange(len(doc), dtype=np.uint64)) >> np.uint64(11)
                at = np.flatnonzero(draw < np.array([share[x] for x in langs[lo:hi]])[doc] * 2.0**53)
                if not len(at):
                    continue
                raw = b"".join(parts)
                yield pd.DataFrame({"draw": draw[at].astype(np.int64), "lang": [langs[lo + i] for i in doc[at]], "window": [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]})

    return run


def training_sample(docs: DataFrame, max_rows: int = MAX_ROWS) -> pd.DataFrame:
    """A bounded sample (window, lang) of the windows of all labelled rows that aren't held out, as many of each
    language; a language with fewer than its share of max_rows keeps them all. Windows are drawn from anywhere in a text;
    which ones depends on doc_id and text alone.

    To the driver come one count a language and max_rows windows at most, or one a language."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    step = WINDOW - max(WIDTHS) + 1
    windows = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - max(WIDTHS) + 1) / step))
    counts = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.sum(windows).alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"window": [], "lang": []})
    quota = max(1, max_rows // len(counts))
    share = {lang: min(1.0, quota / n) for lang, n in counts.items()}
    rows = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("key")).mapInPandas(_drawn(share), "draw long, lang string, window binary")
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "window"))  # of some more than the quota at most
    return rows.withColumn("place", place).filter(F.col("place") <= quota).orderBy("draw", "window").toPandas()[["window", "lang"]]


class ByteNet:
    """Filters of several widths over one-hot bytes (byte 0 pads), max pooling, rectifier, softmax."""

    def __init__(self, langs: list[str], filters: int = FILTERS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.weights = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def pair_tables(self) -> list[np.ndarray]:
        """Sums over byte pairs: width 2; first two of width 3; first and last two of width 4."""
        pair = lambda w, j: (w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1)
        two, three, four = self.weights
        return [pair(two, 0), pair(three, 0), pair(four, 0), pair(four, 2)]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray], arg: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        a, b, c, d = tables
        maps = [a[pairs], b[pairs[:, :-1]] + self.weights[1][2][x[:, 2:]], c[pairs[:, :-2]] + d[pairs[:, 2:]]]
        where = [m.argmax(1) for m in maps] if arg else []
        return np.concatenate([m.max(1) + z for m, z in zip(maps, self.bias, strict=True)], axis=1), where

    def log_probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)))
        for i in range(0, len(x), 64):
            z = np.maximum(self.pooled(x[i : i + 64], tables)[0], 0) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            out[i : i + 64] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, least_steps: int = 800, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam on the cross-entropy; the gradient of max pooling goes to the place of the maximum. A small
        sample is gone through more often, for least_steps in all."""
        rng = np.random.default_rng(seed)
        params = [*self.weights, *self.bias, self.out, self.out_bias]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        step = 0
        parts = max(1, len(x) // 64)
        for _ in range(max(epochs, -(-least_steps // parts))):
            for at in np.array_split(rng.permutation(len(x)), parts):
                step += 1
                batch = x[at]
                z, where = self.pooled(batch, self.pair_tables(), arg=True)
                h = np.maximum(z, 0)
                logits = h @ self.out + self.out_bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                dz = np.split((p @ self.out.T) * (z > 0), len(WIDTHS), axis=1)
                grads = [np.zeros_like(w) for w in self.weights]
                for grad, place, g in zip(grads, where, dz, strict=True):
                    rows, column = np.arange(len(at))[:, None], np.arange(g.shape[1])[None, :]
                    for j in range(len(grad)):
                        byte = batch[rows, place + j].astype(np.int64)
                        grad[j] = np.bincount((byte * g.shape[1] + column).ravel(), g.ravel(), grad[j].size).reshape(grad[j].shape)
                grads += [g.sum(0) for g in dz] + [h.T @ p, p.sum(0)]
                for k, (param, grad) in enumerate(zip(params, grads, strict=True)):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    param -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each text; `und` and 0 if it has no letter."""
        tables = self.pair_tables()
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        has = [bool(t and _LETTER.search(t)) for t in texts]
        for lo, hi in chunks(texts, 1_000_000):
            rows = [i for i in range(lo, hi) if has[i]]
            if not rows or not self.langs:
                continue
            parts = [texts[i].encode("utf-8", "replace") for i in rows]
            data = np.frombuffer(b"".join(parts), np.uint8)
            start, end, doc = cut_windows(parts)
            total = np.zeros((len(rows), len(self.langs)))
            for i in range(0, len(start), 4096):
                s = slice(i, i + 4096)
                logs = self.log_probabilities(gather_windows(data, start[s], end[s]), tables)
                np.add.at(total, doc[s], logs * (end[s] - start[s])[:, None])
            mean = total / np.bincount(doc, end - start, len(rows))[:, None]
            mean = np.exp(mean - mean.max(1, keepdims=True))
            best = mean.argmax(1)
            names[rows] = np.array(self.langs, object)[best]
            scores[rows] = mean[np.arange(len(rows)), best] / mean.sum(1)
        return list(names), scores


def train(docs: DataFrame, **bounds: int) -> ByteNet:
    """A network for the languages of docs, learned from text and lang of rows that aren't held out."""
    ship_code(docs.sparkSession)
    sample = training_sample(docs, **bounds)
    langs = sorted(sample.lang.unique())
    net = ByteNet(langs)
    if len(langs) > 1:
        parts = [bytes(w) for w in sample.window]
        start, end, doc = cut_windows(parts)
        x = gather_windows(np.frombuffer(b"".join(parts) or b"\0", np.uint8), start, end)
        net.fit(x, np.searchsorted(langs, sample.lang)[doc])
    return net


def identify(docs: DataFrame, net: ByteNet) -> DataFrame:
    """docs with held_out, lang_pred and score.

    lang_pred is `und` with score 0 if text is null or has no letter, or if nothing could be
    learned. Every byte of a text is in a window. Other columns pass through; columns with the
    three names are replaced. Equal texts get equal results; an empty table gives an empty one.
    """
    ship_code(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = net.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    (name,) = fresh(docs, "found")
    found = docs.withColumn(name, apply(F.col("text")))
    return found.withColumns({"held_out": held_out(), "lang_pred": F.col(name)["lang_pred"], "score": F.col(name)["score"]}).drop(name)
