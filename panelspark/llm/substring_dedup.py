"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words. Of the hashes of its GRAM-word runs the window's fingerprint
is the least, so equal windows have equal fingerprints and one word in four needs an entry.
Each batch of documents adds one immutable run: a table of (fingerprint, document), bucketed and
sorted by fingerprint. A new run is merge-joined with itself and with the older runs, bucket by
bucket and without a shuffle; compaction merges FANOUT runs of a level into one of the next.

A shared fingerprint is only a hint. The windows around it, in new documents and in the older ones
that share it, are verified by a second, independent hash of all their words, compared among all
documents that have the fingerprint.

Frequent passages are settled close to their rows: inside one piece of a task the documents that
share a fingerprint or a window know so at once, and only the first of them goes into the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch, fresh, ship_code
from .textkit import Words, chunks, mix

WINDOW, GRAM = 13, 6
#: Batches of documents that are indexed one after the other, and runs of a level that are merged into one. The third batch
#: meets the run that those of the first two were compacted into. With each batch the index grows GROWTH-fold.
BATCHES, FANOUT, GROWTH = 3, 2, 4


class _Runs:
    """Of a piece of texts: stretches of window starts (word indices) with one fingerprint each."""

    def __init__(self, texts: list):
        self.words = words = Words(texts)
        grams = _sliding(words.hashes(), GRAM)
        n = len(words.start) - WINDOW + 1
        self.start = self.length = self.fingerprint = self.doc = np.zeros(0, np.int64)
        if n <= 0:
            return
        span = WINDOW - GRAM + 1
        chosen = np.arange(n)
        least = grams[:n].copy()
        for j in range(1, span):
            lower = grams[j : j + n] < least
            least[lower] = grams[j : j + n][lower]
            chosen[lower] = np.flatnonzero(lower) + j
        valid = np.flatnonzero(words.doc[:n] == words.doc[WINDOW - 1 :])
        if not len(valid):
            return
        new = np.concatenate(([True], (np.diff(valid) != 1) | (np.diff(chosen[valid]) != 0) | (np.diff(words.doc[valid]) != 0)))
        at = np.flatnonzero(new)
        self.start = valid[at]
        self.length = np.diff(np.concatenate((at, [len(valid)])))
        self.fingerprint = least[self.start].view(np.int64)
        self.doc = words.doc[self.start]


def _sliding(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every width consecutive words, whatever texts they belong to."""
    from .textkit import _BASE

    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * _BASE + h[j : j + n]
    return mix(out)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(slot, h, doc_id). A row without h is an index entry: fingerprint slot is in doc_id. A row with h is a
    note that doc_id shares h with another document of this piece; its slot only spreads the rows."""
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
        for lo, hi in chunks(texts):
            runs = _Runs(texts[lo:hi])
            if not len(runs.doc):
                continue
            doc, h = ids[lo:hi][runs.doc], runs.fingerprint
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
            doc, h = doc[fresh], h[fresh]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            group = np.cumsum(first) - 1
            many = (np.bincount(group) > 1)[group]
            yield pd.DataFrame({"slot": h[first], "h": pd.array([None] * int(first.sum()), "Int64"), "doc_id": doc[first]})
            if many.any():
                yield pd.DataFrame({"slot": (h * 31 + doc)[many], "h": pd.array(h[many], "Int64"), "doc_id": doc[many]})


def _wanted(runs: _Runs, wanted: list) -> np.ndarray:
    """Which stretches have a fingerprint that their own text's list has; all, where the list is null."""
    every = np.array([hs is None for hs in wanted])
    size = [0 if hs is None else len(hs) for hs in wanted]
    h = np.concatenate([np.zeros(0, np.int64), *(np.asarray(hs, np.int64) for hs in wanted if hs is not None)]).view(np.uint64)
    # one lookup for all texts: a text's own number is added to its fingerprints
    own = mix(np.arange(1, len(wanted) + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        return np.isin(runs.fingerprint.view(np.uint64) + own[runs.doc], h + np.repeat(own, size)) | every[runs.doc]


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of windows with shared fingerprints, those in hs (null: all): (h, doc_id, rid, starts, length, windows).

    windows are their second hashes, starts the places of all stretches of the row that have the same.
    Stretches whose windows all occur in a smaller document of the same piece are settled: they carry no
    hashes. So a passage that every document has, or repeats, is one row in a piece."""
    for pdf in batches:
        texts, ids, rids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(), pdf["rid"].to_numpy()
        wanted = pdf["hs"].tolist()
        for lo, hi in chunks(texts):
            runs = _Runs(texts[lo:hi])
            if not len(runs.doc):
                continue
            hit = _wanted(runs, wanted[lo:hi])
            if not hit.any():
                continue
            start, length, h, own = (x[hit] for x in (runs.start, runs.length, runs.fingerprint, runs.doc))
            base = np.cumsum(length) - length
            window = _sliding(runs.words.hashes(1), WINDOW)[np.repeat(start - base, length) + np.arange(length.sum())]
            doc = np.repeat(ids[lo:hi][own], length)
            order = np.lexsort((doc, window))
            w, d = window[order], doc[order]
            first = np.concatenate(([True], w[1:] != w[:-1]))
            later = np.empty(len(w), bool)
            later[order] = d > d[np.flatnonzero(first)[np.cumsum(first) - 1]]
            settled = np.logical_and.reduceat(later, base)
            raw, places = window.tobytes(), (start - runs.words.first[own]).astype("<i4")
            same: dict[tuple, list[int]] = {}
            for i, (s, o, b, n) in enumerate(zip(settled.tolist(), own.tolist(), base.tolist(), length.tolist(), strict=True)):
                same.setdefault((o, n) if s else (o, n, raw[8 * b : 8 * (b + n)]), []).append(i)
            one = np.fromiter((x[0] for x in same.values()), np.int64, len(same))
            yield pd.DataFrame({
                "h": h[one], "doc_id": ids[lo:hi][own[one]], "rid": rids[lo:hi][own[one]], "starts": [places[x].tobytes() for x in same.values()],
                "length": length[one], "windows": [key[2] if len(key) == 3 else None for key in same],
            })


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition sorted by fingerprint and document: stretches of windows that a smaller document has,
    as (doc_id, rid, starts, length). Settled ones, which carry no windows, pass through.

    A group may be longer than a batch: what its windows' first documents are is carried on.
    """
    carry_h, carry_w, carry_d = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for pdf in batches:
        settled = pdf["windows"].isna().to_numpy()
        if settled.any():
            yield pdf.loc[settled, ["doc_id", "rid", "starts", "length"]]
            pdf = pdf[~settled]
        if not len(pdf):
            continue
        h, ids, length = pdf["h"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["length"].to_numpy()
        keep = len(carry_w) if carry_h == h[0] else 0
        row = np.repeat(np.arange(len(pdf)), length)
        w = np.concatenate((carry_w[:keep], np.frombuffer(b"".join(pdf["windows"]), np.uint64)))
        d = np.concatenate((carry_d[:keep], ids[row]))
        g = np.concatenate((np.full(keep, h[0]), h[row]))
        order = np.lexsort((d, w, g))
        first = np.concatenate(([True], (w[order][1:] != w[order][:-1]) | (g[order][1:] != g[order][:-1])))
        least = np.empty(len(w), np.int64)
        least[order] = d[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
        last = order[first & (g[order] == h[-1])]
        carry_h, carry_w, carry_d = h[-1], w[last], least[last]
        offset = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        at = np.flatnonzero((least < d)[keep:])
        if not len(at):
            continue
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(row[at]) != 0)))
        begin = at[new]
        starts = pdf["starts"].to_numpy()[row[begin]]
        yield pd.DataFrame({
            "doc_id": ids[row[begin]], "rid": pdf["rid"].to_numpy()[row[begin]],
            "starts": [(np.frombuffer(x, "<i4") + o).astype("<i4").tobytes() for x, o in zip(starts, offset[begin].tolist(), strict=True)],
            "length": np.diff(np.concatenate((np.flatnonzero(new), [len(at)]))),
        })


_WHITE = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)


def _joined(text: str | None) -> bytes:
    """The words of a text joined by one space, by passes over its bytes."""
    raw = text.encode("utf-8", "surrogatepass").translate(_WHITE).strip(b" ") if text else b""
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as kept words joined by a space, with n_words and n_removed in place of the last column, the stretches found."""
    for pdf in batches:
        kept, total, gone = [], [], []
        for text, found in zip(pdf["text"].tolist(), pdf.iloc[:, -1].tolist(), strict=True):
            raw = _joined(text)
            n, stay = raw.count(b" ") + 1 if raw else 0, None
            if found is not None and len(found):
                first = np.frombuffer(b"".join([s["starts"] for s in found]), "<i4").astype(np.int64)
                length = np.repeat([s["length"] for s in found], [len(s["starts"]) // 4 for s in found])
                delta = np.bincount(first, minlength=n + 1) - np.bincount(first + length + WINDOW - 1, minlength=n + 1)
                stay = np.cumsum(delta[:-1]) == 0
                between = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
                start, end = np.concatenate(([0], between + 1)), np.append(between, len(raw))
                run = np.flatnonzero(np.diff(np.concatenate(([False], stay, [False])).view(np.int8)))
                raw = b" ".join([raw[a:b] for a, b in zip(start[run[::2]].tolist(), end[run[1::2] - 1].tolist(), strict=True)])
            total.append(n)
            gone.append(n - int(stay.sum()) if stay is not None else 0)
            kept.append(raw.decode("utf-8", "surrogatepass"))
        yield pdf.iloc[:, :-1].assign(text=kept, n_words=total, n_removed=gone)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, in levels; the documents of older batches count as smaller.

    A run is a table bucketed and sorted by fingerprint, so that runs are merge-joined, and merged, bucket
    by bucket without a shuffle. Documents that share a fingerprint inside one piece of a task are noted
    beside it, spread over all tasks: only the least of them is an entry, so that no entry is frequent."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        #: Level, table (slot, h, doc_id) and name.
        self.runs: list[tuple[int, DataFrame, str]] = []

    def _write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        name = f"run-{uuid.uuid4().hex}"
        return self.scratch.save_bucketed(rows, name, "slot", self.buckets), name

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch (doc_id, text) and return (doc_id, h): the fingerprints that more documents share,
        for new documents and for the older ones that they share them with."""
        found = docs.select("doc_id", "text").mapInPandas(_fingerprints, "slot long, h long, doc_id long")
        new, name = self._write(found.repartition(self.buckets, "slot"))
        entries = lambda run, fresh: run.filter("h IS NULL").select("slot", "doc_id", F.lit(fresh).alias("fresh"))
        notes = lambda run: run.filter("h IS NOT NULL").select(F.col("h").alias("slot"), "doc_id")
        # equal buckets of all runs meet where they are, sorted: a merge without a shuffle
        merged = entries(new, 1)
        for _, run, _ in self.runs:
            merged = merged.unionByName(entries(run, 0))
        group = W.partitionBy("slot")
        merged = merged.withColumns({"least": F.min("doc_id").over(group), "most": F.max("doc_id").over(group), "any": F.max("fresh").over(group)})
        shared = merged.filter("least < most AND any = 1").select("slot", "doc_id").unionByName(notes(new))
        for _, run, _ in self.runs:
            shared = shared.unionByName(notes(run).join(new.filter("h IS NULL").select("slot"), "slot", "left_semi"))
        self.runs.append((0, new, name))
        return shared.select("doc_id", F.col("slot").alias("h"))

    def compact(self) -> None:
        """Merge fanout runs of a level into one of the next, as long as a level has as many.

        Call it when the links of the last batch have been used: the old runs are removed."""
        for level in range(64):
            same = [r for r in self.runs if r[0] == level]
            if len(same) < self.fanout:
                continue
            merged = same[0][1]
            for _, run, _ in same[1:]:
                merged = merged.unionByName(run)
            new, name = self._write(merged.groupBy("slot", "h", "doc_id").agg(F.lit(1)).drop("1"))  # bucket by bucket
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, new, name)]
            for _, _, old in same:
                self.scratch.drop(old)


def _covered(docs: DataFrame, shared: DataFrame, new: F.Column) -> DataFrame:
    """(doc_id, rid, starts, length): stretches of window starts of new documents that occur in a smaller one."""
    hints = shared.groupBy("doc_id").agg(F.collect_set("h").alias("hs")).hint("shuffle_hash")
    stretches = docs.join(hints, "doc_id").mapInPandas(_windows, "h long, doc_id long, rid long, starts binary, length long, windows binary")
    # one shuffle for all, so that texts are read and hashed once; settled stretches, which may be many of one fingerprint, are spread by document
    slot = F.when(F.col("windows").isNull(), F.xxhash64("doc_id")).otherwise(F.col("h"))
    dealt = stretches.filter(F.col("windows").isNotNull() | new).repartition(slot).sortWithinPartitions("h", "doc_id")
    return dealt.mapInPandas(_verify, "doc_id long, rid long, starts binary, length long").filter(new)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All rows of docs (doc_id, text) with text as its kept words joined by spaces, and n_words, n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if it is in a window of WINDOW words of one
    document whose word sequence also starts in a document with a smaller doc_id; windows are judged
    on the input. batches splits the ids into ranges that are indexed one after the other, as if they
    came later, each but the first GROWTH - 1 times as large as all before it; the result doesn't depend on it. Null, empty and short texts lose nothing (null becomes
    empty, 0 words), and so does a null doc_id, which is compared with nothing. Equal rows lose the same
    words: they don't count as smaller than each other. An empty table gives an empty one. Other columns
    pass through, whatever their names; n_words and n_removed are replaced.
    """
    spark = docs.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "substrings")
    docs = docs.drop("n_words", "n_removed")
    usable = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    rid, stretches = fresh(docs, "rid", "stretches")
    # dealt out by doc_id once, for all joins with what is found
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.filter(usable).withColumn(rid, F.xxhash64("text")).repartition(buckets, "doc_id")  # tells rows with one doc_id apart
    kept = scratch.save_bucketed(kept, "documents", "doc_id", buckets)
    known = kept.select("doc_id", "text", F.col(rid).alias("rid"))
    index = FingerprintIndex(scratch, fanout)
    cuts = []
    if batches > 1:
        cuts = known.select(F.percentile_approx("doc_id", [GROWTH**-i for i in range(batches - 1, 0, -1)])).first()[0] or []
    cuts = sorted(set(cuts))
    covered = None
    for i in range(len(cuts) + 1):
        low = F.lit(True) if i == 0 else F.col("doc_id") > cuts[i - 1]
        high = F.lit(True) if i == len(cuts) else F.col("doc_id") <= cuts[i]
        shared = index.add(known.filter(low & high))
        found = scratch.save(_covered(known.filter(high), shared, low), f"found-{i}")
        if i < len(cuts):
            index.compact()  # for the batches to come
        covered = found if covered is None else covered.unionByName(found)
    covered = covered.groupBy("doc_id").agg(F.collect_list(F.struct("rid", "starts", "length")).alias(stretches)).hint("shuffle_hash")
    own = F.filter(stretches, lambda x: x["rid"] == F.col(rid))
    rows = kept.join(covered, "doc_id", "left").select(*docs.columns, own.alias(stretches))
    rest = docs.filter(~usable).withColumn(stretches, F.lit(None).cast(rows.schema[stretches].dataType))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.unionByName(rest).mapInPandas(_clean, f"{fields}, n_words long, n_removed long")
