"""Byte-level BPE: pre-tokenisation by scans of transition functions, cached merging, decoding.

The split that the vocabularies expect (contractions, letters, numbers, other signs, white space) is
a small automaton over classes of code points, once each class knows what follows it. A code point is
then a function from state to state; the functions that arise from composing them are few, so that
composition is a table, and all states are found by an associative scan over whole batches.

Pieces that aren't in the cache are merged side by side, one pair of each a round.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship_code
from .textkit import column_chunks

LETTER, NUMBER, OTHER, SPACE, PREFIX, BREAK, SHORT, LONG, RESET = range(9)
#: States: token closed; in letters, numbers, signs, white space; after a blank that joins what follows;
#: one or two letters of a contraction to come.
_STATES = 8
#: Bytes of texts or ids that a task takes at once; code points of a scan; pieces that are looked up at once.
CHUNK, SEGMENT, PIECES = 500_000, 500_000, 100_000
#: Bytes in each of two generations of the cache; a piece of more bytes is merged for itself and not kept.
CACHE_BYTES, LONG_PIECE = 30_000_000, 64
_NO_MERGE = 1 << 60
#: The code points of the property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(state, symbol) -> next state; (state, symbol) -> whether a token starts."""
    go, starts = np.zeros((_STATES, 9), np.uint8), np.ones((_STATES, 9), bool)
    for symbol, inside in ((LETTER, 1), (NUMBER, 2), (OTHER, 3)):
        go[:, symbol] = inside
        starts[[inside, 5], symbol] = False
    go[6, LETTER], go[7, LETTER] = 0, 6
    starts[[6, 7], LETTER] = False
    go[:, SPACE] = 4
    starts[4, SPACE] = False
    go[:, PREFIX] = 5
    go[:, SHORT], go[:, LONG] = 6, 7
    go[[3, 5], SHORT] = go[[3, 5], LONG] = 3
    starts[[3, 5], SHORT] = starts[[3, 5], LONG] = False
    return go, starts


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions that symbols and their compositions are (symbols first); table of "a, then b"; identity's place."""
    go, _ = _automaton()
    found = [tuple(range(_STATES))]
    generators = [tuple(go[:, s]) for s in range(9)]
    place = {found[0]: 0}
    for f in generators:
        place.setdefault(f, len(place))
    found = list(place)
    i = 0
    while i < len(found):
        for g in generators:
            h = tuple(g[s] for s in found[i])
            if h not in place:
                place[h] = len(found)
                found.append(h)
        i += 1
    table = np.array([[place[tuple(b[s] for s in a)] for b in found] for a in found], np.uint16)
    return np.array(found, np.uint8), table, np.array([place[g] for g in generators], np.uint16)


def scan(elements: np.ndarray, table: np.ndarray, block: int = 128) -> np.ndarray:
    """All prefix compositions of elements, 0 being the identity: in blocks side by side, then over the blocks."""
    n = len(elements)
    if n <= block:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // block)
    grid = np.zeros(rows * block, elements.dtype)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = table[grid[j - 1], grid[j]]
    before = np.concatenate((np.zeros(1, grid.dtype), scan(grid[-1], table, block)[:-1]))
    return table[before[None, :], grid].T.reshape(-1)[:n]


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point. ends: places of separators between texts."""
    kind = _classes()[points]
    kind[ends] = RESET
    after = np.append(kind[1:], RESET)
    last = (kind == SPACE) & (after != SPACE) & (after != RESET)
    out = kind.copy()
    out[last] = np.where(points[last] == 32, PREFIX, BREAK)
    quote = np.flatnonzero((points == 39) & (kind != RESET))
    padded = np.concatenate((points, np.zeros(2, points.dtype)))
    one, two = padded[quote + 1], padded[quote + 2]
    is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
    long = (is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    out[quote[is_(one, "stmd")]] = SHORT
    out[quote[long]] = LONG
    return out


def token_starts(points: np.ndarray, ends: np.ndarray, state: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pre-token starts at each code point, and the state after each, from the given one on."""
    functions, table, generator = _monoid()
    _, starts = _automaton()
    symbol = symbols(points, ends)
    after = functions[scan(generator[symbol], table), state]
    before = np.concatenate((np.array([state], np.uint8), after[:-1]))
    return starts[before, symbol], after


def boundaries(joined: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens and the separators at ends begin in joined, in code points and in UTF-8 bytes.

    The string is scanned in segments: the state goes on from one to the next, and the two code points that
    a symbol looks ahead at belong to both."""
    places, offsets = [], []
    state = size = 0
    for lo in range(0, len(joined), SEGMENT):
        part = joined[lo : lo + SEGMENT + 2]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        inside = ends[np.searchsorted(ends, lo) : np.searchsorted(ends, lo + len(points))] - lo
        starts, after = token_starts(points, inside, state)
        n = min(SEGMENT, len(points))
        at = np.flatnonzero(starts[:n])
        points, state = points[:n], int(after[n - 1])
        width = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)
        places.append(at + lo)
        offsets.append(size + np.where(at > 0, width[at - 1], 0))
        size += int(width[-1])
    return np.concatenate(places), np.concatenate(offsets)


class Vocabulary:
    """Byte strings and their ranks; a rank is an id and the priority of the merge that makes it."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = size = max(self.ranks.values()) + 1
        strings = [b""] * size
        for s, r in self.ranks.items():
            strings[r] = s
        self.length = np.fromiter(map(len, strings), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for s, r in self.ranks.items():
            for i in range(1, len(s)):
                left, right = self.ranks.get(s[:i]), self.ranks.get(s[i:])
                if left is not None and right is not None:
                    pairs[left * size + right] = r
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()] or [_NO_MERGE], np.int64)
        #: Ids, as bytes, of short pieces. What the old generation holds stays as long as it is asked for.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        return np.where(self.pairs[at] == key, self.merged[at], _NO_MERGE) if len(self.pairs) else np.full(len(key), _NO_MERGE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of non-empty pieces: of all neighbours in a piece the pair of the least rank merges first, the
        leftmost of equals. A round makes one merge in every piece that has one left."""
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.append(self._pair_ranks(ids[:-1], ids[1:]), _NO_MERGE)
        rank[:-1][owner[1:] != owner[:-1]] = _NO_MERGE
        done = []
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            count = np.diff(np.append(start, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, start), count)
            over = least == _NO_MERGE
            if over.any():
                done.append((owner[over], ids[over]))
                live = ~over
                owner, ids, rank, least = owner[live], ids[live], rank[live], least[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            owner, ids, rank = owner[stay], ids[stay], rank[stay]
            at -= np.arange(len(at))  # each merge before a place removed one element
            at = np.concatenate((at, at[at > 0] - 1))
            after = np.minimum(at + 1, len(ids) - 1)
            inside = (after > at) & (owner[at] == owner[after])
            rank[at] = np.where(inside, self._pair_ranks(ids[at], ids[after]), _NO_MERGE)
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        stop = 4 * np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(pieces)))))
        raw = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(stop.tolist(), stop[1:].tolist(), strict=False)]

    def merge_long(self, piece: bytes) -> bytes:
        """As merge, for one piece of any length: a heap of ranks and places over linked parts."""
        ranks, n = self.ranks, len(piece)
        ahead, back = array("i", range(1, n + 2)), array("i", range(-1, n))
        wait = array("i", [-1]) * n  # the rank at which a part merges with the next, -1 if it doesn't

        def look(i: int) -> None:
            j = ahead[i]
            r = ranks.get(piece[i : ahead[j]]) if j < n else None
            wait[i] = -1 if r is None else r
            if r is not None:
                heapq.heappush(heap, r << 32 | i)

        heap: list[int] = []
        for i in range(n):
            look(i)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if wait[i] != top >> 32:
                continue
            gone = ahead[i]
            wait[gone] = -1
            ahead[i] = ahead[gone]
            if ahead[i] < n:
                back[ahead[i]] = i
            look(i)
            if back[i] >= 0:
                look(back[i])
        out, i = array("I"), 0
        while i < n:
            out.append(ranks[piece[i : ahead[i]]])
            i = ahead[i]
        return np.array(out, "<u4").tobytes()

    def _put(self, piece: str, ids: bytes) -> None:
        self.young[piece] = ids
        self.held += 250 + len(piece) + len(ids)

    def table(self, pieces: list[str]) -> dict[str, bytes]:
        """A table that has the ids of all the pieces. Those that aren't long are known from then on."""
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        long, fresh, raws = {}, [], []
        for p in set(pieces).difference(self.young):
            if (ids := self.old.get(p)) is not None:
                self._put(p, ids)
                continue
            raw = p.encode("utf-8", "surrogatepass")
            if (r := self.ranks.get(raw)) is not None:
                self._put(p, r.to_bytes(4, "little"))
            elif len(raw) > LONG_PIECE:
                long[p] = self.merge_long(raw)
            else:
                fresh.append(p)
                raws.append(raw)
        for p, ids in zip(fresh, self.merge(raws), strict=True):
            self._put(p, ids)
        return self.young | long if long else self.young

    def encode(self, texts: list) -> list[tuple[bytes, bytes]]:
        """Ids and offsets of each text, both as little-endian 32-bit integers; None is an empty text.

        offsets: the byte at which each pre-token begins, and the number of bytes."""
        if not texts:
            return []
        joined = "\n".join(t or "" for t in texts) + "\n"
        ends = np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))) - 1
        starts, at = boundaries(joined, ends)
        cuts = np.searchsorted(starts, ends)
        ids: list[list[bytes]] = [[] for _ in texts]
        doc, stops = 0, cuts.tolist()
        for lo in range(0, len(starts), PIECES):
            hi = min(lo + PIECES, len(starts))
            bounds = [*starts[lo : hi + 1].tolist(), len(joined)]
            pieces = [joined[a:b] for a, b in zip(bounds, bounds[1 : hi - lo + 1], strict=False)]
            table, place = self.table(pieces), lo
            while place < hi:
                stop = min(stops[doc], hi)
                ids[doc].append(b"".join(map(table.__getitem__, pieces[place - lo : stop - lo])))
                if stop < hi:  # the separator after the text
                    doc, stop = doc + 1, stop + 1
                place = stop
        first = np.concatenate(([0], cuts[:-1] + 1))
        return [(b"".join(x), (at[a : b + 1] - at[a]).astype("<u4").tobytes()) for x, a, b in zip(ids, first.tolist(), stops, strict=True)]

    def decode(self, blobs: list) -> list[bytes]:
        """The bytes that ids stand for."""
        ids = np.frombuffer(b"".join(blobs), "<u4")
        parts = []
        for lo in range(0, len(ids), SEGMENT // 4):
            part = ids[lo : lo + SEGMENT // 4]
            length = self.length[part]
            stop = np.cumsum(length)
            parts.append(self.bytes[np.repeat(self.start[part] - (stop - length), length) + np.arange(stop[-1])].tobytes())
        raw = b"".join(parts)
        sizes = np.concatenate(([0], np.cumsum(self.length[ids])))
        edge = sizes[np.cumsum([0] + [len(b) // 4 for b in blobs])].tolist()
        return [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, offsets) for every row of docs (doc_id, text), by the rank file at path.

    Both are little-endian 32-bit integers: the ids, and the byte at which each pre-token begins
    followed by the number of bytes. Null and empty texts have no ids and the one offset 0. A null
    doc_id stays null; repeated rows are encoded each for itself; other columns are ignored.

    A task holds about CHUNK bytes of texts at once, or one text, and a cache of 2 x CACHE_BYTES.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for lo, hi in column_chunks(batch.column("text"), CHUNK):
                found = words.encode(batch.column("text")[lo:hi].to_pylist())
                columns = [batch.column("doc_id")[lo:hi], *(pa.array(x, pa.binary()) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, offsets binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids, offsets) with decoded, the bytes of the text.

    The last offset says how many bytes there must be; another number is an error."""
    ship_code(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for lo, hi in column_chunks(batch.column("ids"), CHUNK):
                part = batch.slice(lo, hi - lo)
                texts = words.decode(part.column("ids").to_pylist())
                for text, offsets in zip(texts, part.column("offsets"), strict=True):
                    if len(text) != int.from_bytes(offsets.as_py()[-4:], "little"):
                        raise ValueError("ids don't decode to as many bytes as were encoded")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "offsets", "decoded"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, ids binary, offsets binary, decoded binary")
