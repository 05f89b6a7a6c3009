"""A durable log-structured index of windows for substring dedup, batch after batch.

remove_repeats of substring_dedup judges one table. Here the index outlives the call: it is a folder of
immutable runs and a manifest that names them. A run holds, for each fingerprint, the second hashes of all
windows that have it, bucketed and sorted by fingerprint. A new batch is merge-joined with the runs, bucket
by bucket, and its windows are verified by their second hashes against those in the runs: texts of older
batches are never read again. Then the batch's own windows become a run; runs of a level are compacted into
one of the next, in which each window is held once. A manifest is written after its runs are whole, under the next
number, so that a reader, or a writer that starts anew, sees the index before or after a batch, never between.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, ship_code
from .store import located
from .substring_dedup import FANOUT, _clean, _verify, _windows

_ROW = "h long, doc_id long, rid long, starts binary, length long, windows binary"


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All stretches of windows, as _windows gives those of wanted fingerprints; slot is the fingerprint, or spreads those that are settled."""
    for pdf in _windows(pdf.assign(hs=None) for pdf in batches):
        yield pdf.assign(slot=np.where(pdf["windows"].isna(), pdf["doc_id"], pdf["h"]))


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint's windows once, from (slot, windows) sorted by slot; a fingerprint's last row is held back for what follows."""
    held_h, held = None, np.zeros(0, np.uint64)
    for pdf in batches:
        if not len(pdf):
            continue
        blobs, h = pdf["windows"].tolist(), pdf["slot"].to_numpy()
        w = np.concatenate((held, np.frombuffer(b"".join(blobs), np.uint64)))
        g = np.concatenate((np.full(len(held), held_h if held_h is not None else 0), np.repeat(h, [len(b) // 8 for b in blobs])))
        order = np.lexsort((w, g))
        w, g = w[order], g[order]
        first = np.concatenate(([True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])))
        w, g = w[first], g[first]
        cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        raw = [w[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(w)), strict=True)]
        held_h, held = g[cut[-1]], w[cut[-1] :]
        if len(cut) > 1:
            yield pd.DataFrame({"slot": g[cut[:-1]], "windows": raw[:-1]})
    if held_h is not None:
        yield pd.DataFrame({"slot": [held_h], "windows": [held.tobytes()]})


class SubstringIndex:
    """The index in folder. Documents of older batches count as smaller than those of a new one, whatever their ids."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int, runs: list[tuple[int, str]], number: int):
        ship_code(spark)
        self.spark, self.folder, self.buckets, self.fanout, self.runs, self.number = spark, folder.rstrip("/"), buckets, fanout, runs, number

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int = 64, fanout: int = FANOUT) -> SubstringIndex:
        """A new index; an error if the folder has one. buckets can't change later."""
        made = cls(spark, folder, buckets, fanout, [], 0)
        if made._manifests():
            raise ValueError(f"{folder} has an index")
        made._commit([])
        return made

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SubstringIndex:
        """The index as its last manifest says, in any session."""
        made = cls(spark, folder, 0, 0, [], 0)
        names = made._manifests()
        if not names:
            raise ValueError(f"{folder} has no index")
        files, at = located(made.folder)
        with files.open_input_file(f"{at}/{names[-1]}") as f:
            held = json.loads(f.read())
        return cls(spark, folder, held["buckets"], held["fanout"], [tuple(r) for r in held["runs"]], held["number"])

    def _manifests(self) -> list[str]:
        from pyarrow import fs

        files, at = located(self.folder)
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        files, at = located(self.folder)
        files.create_dir(at, recursive=True)
        number = self.number + 1
        with files.open_output_stream(f"{at}/manifest-{number:012d}.json") as f:
            f.write(json.dumps({"number": number, "buckets": self.buckets, "fanout": self.fanout, "runs": runs}).encode())
        self.runs, self.number = runs, number

    def _write(self, rows: DataFrame) -> str:
        name, table = f"run-{uuid.uuid4().hex}", f"panelspark_{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "slot").sortBy("slot").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return name

    def _read(self, name: str) -> DataFrame:
        table = f"panelspark_{uuid.uuid4().hex}"
        place = f"{self.folder}/{name}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {table} (slot BIGINT, windows BINARY) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        run = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return run

    def add(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text) without the words of windows that an older batch, or a document of this one with a smaller id, has: doc_id,
        text as kept words joined by spaces, n_words, n_removed. The batch then is in the index.

        Null and short texts lose nothing (null becomes empty, 0 words); rows with a null doc_id are compared with nothing and aren't
        indexed. Rows that are equal in doc_id and text lose the same words. Other columns pass through; n_words and n_removed are
        replaced. An empty batch changes nothing."""
        scratch = Scratch(self.spark, "index-batch")
        docs = docs.drop("n_words", "n_removed")
        usable = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
        known = docs.filter(usable).select("doc_id", "text", F.xxhash64("text").alias("rid"))
        made = known.mapInPandas(_stretches, f"{_ROW}, slot long").repartition(self.buckets, "slot")
        new = scratch.save_bucketed(made, "stretches", "slot", self.buckets)
        open_ = new.filter("windows IS NOT NULL")
        own = open_.select("slot", "h", "doc_id", "rid", "starts", "length", "windows", F.lit(True).alias("fresh"))
        least = F.lit(-(2**63)).cast("long")
        for _, name in self.runs:
            # equal buckets meet where they are: no shuffle of the runs
            met = self._read(name).join(open_.select("slot"), "slot", "left_semi")
            old = met.select("slot", F.col("slot").alias("h"), least.alias("doc_id"), F.lit(0).cast("long").alias("rid"), F.lit(b"\0\0\0\0").alias("starts"), F.expr("CAST(octet_length(windows) DIV 8 AS BIGINT)").alias("length"), "windows", F.lit(False).alias("fresh"))
            own = own.unionByName(old)
        verified = own.repartition(self.buckets, "slot").sortWithinPartitions("h", "doc_id").mapInPandas(_verify, "doc_id long, rid long, starts binary, length long")
        settled = new.filter("windows IS NULL").select("doc_id", "rid", "starts", "length")
        found = scratch.save(settled.unionByName(verified), "covered")
        kept = open_.select("slot", "windows").sortWithinPartitions("slot").mapInPandas(_distinct, "slot long, windows binary")
        runs = list(self.runs)
        if not open_.isEmpty():
            runs.append((0, self._write(kept)))
        self._commit(self._compacted(runs))
        stretches = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("rid", "starts", "length")).alias("_found"))
        rows = docs.join(stretches, (F.col("doc_id") == F.col("_doc")) & usable, "left")
        rows = rows.select(*docs.columns, F.filter("_found", lambda x: x["rid"] == F.xxhash64("text")).alias("_found"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return rows.mapInPandas(_clean, f"{fields}, n_words long, n_removed long")

    def _compacted(self, runs: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """runs after merging fanout runs of a level into one of the next, as long as a level has as many. Files of the old ones
        stay for readers of older manifests; clean() removes them."""
        level = 0
        while level <= max((at for at, _ in runs), default=-1):
            same = [name for at, name in runs if at == level]
            if len(same) >= self.fanout:
                merged = self._read(same[0])
                for name in same[1:]:
                    merged = merged.unionByName(self._read(name))
                merged = merged.repartition(self.buckets, "slot").sortWithinPartitions("slot").mapInPandas(_distinct, "slot long, windows binary")
                runs = [(at, name) for at, name in runs if at != level] + [(level + 1, self._write(merged))]
            level += 1
        return runs

    def clean(self) -> None:
        """Remove runs and manifests that the last manifest doesn't name. No other session may be reading older ones."""
        from pyarrow import fs

        files, at = located(self.folder)
        kept = {name for _, name in self.runs} | {f"manifest-{self.number:012d}.json"}
        for f in files.get_file_info(fs.FileSelector(at)):
            if f.base_name not in kept and f.base_name.startswith(("run-", "manifest-")):
                (files.delete_dir if f.type == fs.FileType.Directory else files.delete_file)(f.path)
