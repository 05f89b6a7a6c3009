"""Groups of rows with equal keys out of a sorted stream of batches, without one task call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def key_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(key, columns) for each run of equal keys, for a partition that is sorted by them."""
    held: list[dict[str, np.ndarray]] = []
    key: tuple | None = None

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for pdf in batches:
        if not len(pdf):
            continue
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(len(pdf) - 1, bool)
        for k in keys:
            change |= columns[k][1:] != columns[k][:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(pdf)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(columns[k][lo] for k in keys)
            if held and now != key:
                yield key, joined()
                held = []
            key = now
            held.append({c: v[lo:hi] for c, v in columns.items()})
    if held:
        yield key, joined()
