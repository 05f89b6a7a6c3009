"""Words and byte windows of whole batches of texts as flat NumPy arrays."""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Characters of a batch that are hashed at once; a longer text is a batch of its own.
CHUNK_CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(33))


def chunks(texts: list, limit: int = CHUNK_CHARS):
    """Slices of a list of texts, of limit characters at most unless one text is longer."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def column_chunks(column, limit: int = CHUNK_CHARS):
    """As chunks, of an Arrow column of texts; only lengths are looked at."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield start, stop
        start = stop


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the given texts.

    start, end: byte places in raw; doc: index of each word's text; first: index of each text's
    first word, with the total at its end. None is a text without words.
    """

    def __init__(self, texts: list, lower: bool = False):
        parts = [((t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"") for t in texts]
        self.raw = b"\n".join(parts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.data = data

    def hashes(self, family: int = 0) -> np.ndarray:
        """64 bits for each word, independent in each of two families: a polynomial over its bytes
        by differences of prefix sums, mixed."""
        with np.errstate(over="ignore"):
            powers = _powers(len(self.data))
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[family][self.data] * powers, dtype=np.uint64)))
            spread = (prefix[self.end] - prefix[self.start]) * _inverses(len(self.data))[self.start]
            return mix(spread + (self.end - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of width words inside one text, and the index of the first word of each."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            out = np.zeros(n, np.uint64)
            for j in range(width):
                out = out * _BASE + hashes[j : j + n]
            at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
            return mix(out[at]), at


_tables: dict = {}


def _table(kind: str, factor: np.uint64, n: int) -> np.ndarray:
    if len(_tables.get(kind, ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _tables[kind] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, factor))), dtype=np.uint64)
    return _tables[kind][:n]


def _powers(n: int) -> np.ndarray:
    return _table("powers", _BASE, n)


def _inverses(n: int) -> np.ndarray:
    return _table("inverses", np.uint64(pow(int(_BASE), -1, 2**64)), n)
