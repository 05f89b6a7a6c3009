"""Packing of tokenized documents into windows by non-negative least squares over a length histogram.

A document is cut into full windows and a remainder. The histogram of remainders, one count for each
length below the window, is all that planning needs. Shallow combinations, two or three lengths that
fill a window exactly, are the columns of a non-negative least-squares problem whose solution, rounded
down, says how often each combination is made. What is left is packed greedily one after the other
and cut at the window's end. Each document finds its own place from its rank among the remainders of
its length.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch
from .textkit import column_chunks

WINDOW = 2048
END_ID = 1
#: Lengths that triples are made of are those with the largest counts, at most this many.
TRIPLE_LENGTHS = 96
#: Bytes of texts that a task takes at once, and of one text that is split at once.
CHUNK, STRETCH = 500_000, 500_000
#: Bytes in a generation of a table; longer strings aren't kept.
TABLE_BYTES, LONG_STRING = 50_000_000, 64
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ranges(points: list[int]) -> str:
    """A regular expression's character class of sorted code points, without the brackets."""
    p = np.array(points)
    edge = np.flatnonzero(np.concatenate(([True], np.diff(p) != 1, [True])))
    return "".join(rf"\u{p[i]:04x}-\u{p[j - 1]:04x}" for i, j in zip(edge[:-1], edge[1:], strict=True))


@cache
def _splitter() -> tuple[re.Pattern, re.Pattern]:
    """What isn't plain in a text, and the pieces that the tokenizer's own split makes of lower-case plain text.

    Plain code points are alike in all versions of Unicode that a tokenizer may know: of one class since the first
    whose database is at hand, in normal form whatever is next to them, and one code point of that class in lower
    case, also at a word's end. A special token's first two signs aren't plain."""
    old = unicodedata.ucd_3_2_0.category
    kind: dict[str, list[int]] = {"L": [], "N": [], "": []}
    for c in range(0x21, 0xD800):
        x = chr(c)
        k, low = unicodedata.category(x)[0], x.lower()
        if k not in "LNPS" or x.isspace() or old(x)[0] != k or 0x1100 <= c < 0x1200 or c == 0x3A3:
            continue
        if len(low) == 1 and old(low)[0] == k and unicodedata.is_normalized("NFC", x) and unicodedata.is_normalized("NFC", low):
            kind[k if k in "LN" else ""].append(c)
    letters, numbers, others = (_ranges(x) for x in kind.values())
    odd = re.compile(rf"[^{letters}{numbers}{others}\x20\x09-\x0D]|<\|")
    return odd, re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{numbers}]|[{others}]+")


@cache
def _byte_signs() -> dict[int, int]:
    """The sign of each byte in vocabularies of bytes: itself if it is visible, else one of those from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


#: How a tokenizer file says that it drops white space, lowers case and splits by classes of code points.
SPLIT_BY_CLASS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


class Encoder:
    """Ids, as little-endian 32-bit integers, of texts.

    A tokenizer whose file says SPLIT_BY_CLASS drops white space and splits the rest by classes of code points before it
    merges bytes, so that a text's ids are those of its pieces, and these repeat. Strings between blanks that aren't plain
    go through the whole tokenizer, and so do all texts of any other tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        self.by_class = all(file.get(k) == v for k, v in SPLIT_BY_CLASS.items()) and file["model"].get("end_of_word_suffix") == "</w>"
        self.model = self.tokenizer.model
        self.pieces, self.strings = _Table(self._piece), _Table(self._string)

    def _piece(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_byte_signs())
        return np.array([t.id for t in self.model.tokenize(signs)], "<u4").tobytes()

    def _string(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _splitter()[1].findall(text.lower())))

    def _stretch(self, text: str) -> bytes:
        odd = _splitter()[0]
        if not odd.search(text):
            return self._plain(text)
        parts, plain = [], []
        for string in _BLANK.split(text):
            if odd.search(string):
                parts += [self._plain(" ".join(plain)), self.strings[string]]
                plain = []
            else:
                plain.append(string)
        return b"".join([*parts, self._plain(" ".join(plain))])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, a stretch of it at a time; None is an empty text."""
        if not self.by_class:
            return self._string(text or "")
        parts, at = [], 0
        while text and at < len(text):
            blank = _BLANK.search(text, at + STRETCH)
            stop = blank.end() if blank else len(text)
            parts.append(self._stretch(text[at:stop]))
            at = stop
        return b"".join(parts)


class _Table(dict):
    """Of a function from strings to bytes: values that were asked for of late, in two generations."""

    def __init__(self, find: Callable):
        super().__init__()
        self.find, self.held, self.old = find, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= LONG_STRING:
            if self.held > TABLE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += 250 + len(key) + len(value)
        return value


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokenize(path: str, end_id: int):
    """Ids of each document, compressed, with its number in the task and its rank among equal remainders there."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(WINDOW, np.int64)
        windows = 0
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo, hi in column_chunks(batch.column("text"), CHUNK):
                ids = [words.encode(x) + end for x in batch.column("text")[lo:hi].to_pylist()]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                rest = n % WINDOW
                order = np.argsort(rest, kind="stable")
                place = np.empty(len(n), np.int64)
                begins = np.searchsorted(rest[order], rest[order])
                place[order] = np.arange(len(n)) - begins
                rank = seen[rest] + place
                seen += np.bincount(rest, minlength=WINDOW)
                full = n // WINDOW
                before = windows + np.cumsum(full) - full
                windows += int(full.sum())
                columns = {"task": np.full(len(n), task), "doc_tokens": n, "rest": rest, "rank": rank, "windows_before": before}
                arrays = [batch.column("doc_id")[lo:hi], *map(pa.array, columns.values()), pa.array([squeeze.compress(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns, "ids"])

    return run


def combinations(count: np.ndarray, window: int = WINDOW, triple_lengths: int = TRIPLE_LENGTHS) -> np.ndarray:
    """Rows of three lengths, ascending, 0 for none, that fill the window and occur in count."""
    there = np.flatnonzero(count)
    there = there[there > 0]
    pairs = there[(there <= window // 2)]
    pairs = pairs[count[window - pairs] > 0]
    rows = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    common = np.sort(there[np.argsort(-count[there], kind="stable")[:triple_lengths]])
    a, b = (x.ravel() for x in np.meshgrid(common, common, indexing="ij"))
    c = window - a - b
    ok = (a <= b) & (b <= c)
    ok[ok] = count[c[ok]] > 0
    rows.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(rows).astype(np.int64)


def non_negative_least_squares(combos: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """x >= 0 for a small |A x - count|, A[length, combo] being how often the combo has the length.

    Multiplicative updates x *= A'count / A'Ax, which keep x non-negative and never raise the residual."""
    has = combos > 0
    x = np.where(has, count[combos], np.inf).min(1) / 3.0 if len(combos) else np.zeros(0)
    up = np.where(has, count[combos], 0).sum(1)
    for _ in range(rounds):
        made = np.zeros(len(count))
        for j in range(3):
            np.add.at(made, combos[:, j], np.where(has[:, j], x, 0))
        down = np.where(has, made[combos], 0).sum(1)
        x = x * np.divide(up, down, out=np.zeros_like(x), where=down > 0)
    return x


class Plan:
    """Where the remainder of rank r among those of its length goes.

    combos and times: the combinations and how often each is made; base: their first sequence.
    For each length: ends, the ranks at which one use of it ends and the next begins, with the
    combination and the offset of each use. Ranks beyond are packed one after the other by length.
    """

    def __init__(self, count: np.ndarray, window: int = WINDOW):
        count = count.astype(np.int64).copy()
        count[0] = 0
        combos = combinations(count, window)
        wish = np.floor(non_negative_least_squares(combos, count) + 1e-6).astype(np.int64)
        left = count.copy()
        times = np.zeros(len(combos), np.int64)
        for i in np.argsort(-wish, kind="stable"):
            parts, need = np.unique(combos[i][combos[i] > 0], return_counts=True)
            times[i] = max(0, min(wish[i], (left[parts] // need).min()))
            left[parts] -= times[i] * need
        combos, times = combos[times > 0], times[times > 0]
        self.window, self.base = window, np.cumsum(times) - times
        self.planned = int(times.sum())
        uses: list[list[tuple[int, int, int]]] = [[] for _ in range(len(count))]
        for i, combo in enumerate(combos):
            offset = 0
            for length in combo[combo > 0]:
                uses[length].append((int(times[i]), i, offset))
                offset += int(length)
        self.ends = [np.cumsum([u[0] for u in us]) if us else np.zeros(0, np.int64) for us in uses]
        self.which = [np.array([u[1] for u in us], np.int64) for us in uses]
        self.offset = [np.array([u[2] for u in us], np.int64) for us in uses]
        rest = left * np.arange(len(count))
        self.rest_base = np.cumsum(rest) - rest
        self.sequences = self.planned + -(-int(rest.sum()) // window)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of the pieces of a remainder."""
        ends = self.ends[length]
        use = int(np.searchsorted(ends, rank, side="right"))
        if use < len(ends):
            sequence = int(self.base[self.which[length][use]]) + rank - (int(ends[use - 1]) if use else 0)
            return [(0, length, sequence, int(self.offset[length][use]))]
        at = int(self.rest_base[length]) + (rank - (int(ends[-1]) if len(ends) else 0)) * length
        first = min(length, self.window - at % self.window)
        out = [(0, first, self.planned + at // self.window, at % self.window)]
        return out + [(first, length - first, out[0][2] + 1, 0)] if first < length else out


def _cut(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        names = ["doc_id", "doc_tokens", "rest", "rank", "offset", "windows_before", "windows_base", "ids"]
        for pdf in batches:
            out = []
            for doc, n, rest, rank, offset, before, base, packed in zip(*(pdf[c].tolist() for c in names), strict=True):
                ids = unpack.decompress(packed)
                full = n - rest
                first = plan.sequences + base + before
                pieces = [(s, WINDOW, first + s // WINDOW, 0) for s in range(0, full, WINDOW)]
                if rest:
                    pieces += [(full + s, k, q, o) for s, k, q, o in plan.place(rest, rank + offset)]
                out += [(doc, s, k, n, q, o, ids[4 * s : 4 * (s + k)]) for s, k, q, o in pieces]
                if len(out) > 2000:
                    yield _pieces(out)
                    out = []
            if out:
                yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return out.assign(doc_id=pd.array(out["doc_id"], "Int64"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all rows of docs (doc_id, text).

    ids are the piece's ids as little-endian unsigned 32-bit integers. A sequence's pieces fill it from
    offset 0 without gaps; all sequences are full but the last of those packed greedily. Null and empty
    texts have the end id alone. A null doc_id stays null; repeated rows are packed each for itself.
    Other columns of docs are ignored. An empty table gives no pieces.

    To the driver come the histogram of remainders (2,047 counts at most) and nothing that grows with
    the rows. Ranks are counted in each task and shifted by the sums of the tasks before.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    schema = "doc_id long, task long, doc_tokens long, rest long, rank long, windows_before long, ids binary"
    tokens = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(tokenizer_path, end_id), schema), "tokens")
    by_task = tokens.groupBy("task", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {WINDOW}")).alias("windows"))
    by_task = scratch.save(by_task, "by-task")
    count = np.zeros(WINDOW, np.int64)
    for row in by_task.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        count[row["rest"]] = row["n"]
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = by_task.groupBy("task").agg(F.sum("windows").alias("w")).select("task", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("windows_base"))
    earlier = W.partitionBy("rest").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("task", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")).join(bases, "task")
    # offsets has a row for each length in each task, so that it grows with the corpus: never broadcast
    placed = tokens.join(scratch.save(offsets, "offsets").hint("shuffle_hash"), ["task", "rest"])
    return placed.mapInPandas(_cut(Plan(count)), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
