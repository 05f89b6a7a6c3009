"""Line dedup: lines that spread over many sites are boilerplate and stay once in the corpus.

Per line hash a HyperLogLog sketch of the sites is merged by aggregation. A line whose estimate is
clearly above or below the threshold is decided by it; lines near the threshold get an exact
distinct count. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, fresh

MIN_SITES = 10
LG_K = 12


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: its 128-bit hash, document, position and site. doc_id and rid, the
    text's hash, tie it to its row."""
    rid = F.xxhash64("text")
    split = docs.select(rid.alias("rid"), "doc_id", F.col("source").cast("string").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    return split.filter(line != "").select(F.unhex(F.md5(line)).alias("key"), "site", "rid", "doc_id", "pos")


def boilerplate(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Line hashes found on min_sites sites at least, with their first place in the corpus.

    The sketch decides outside an interval of six standard errors around the threshold (one at
    least); inside it the distinct sites are counted exactly, by a two-phase aggregation that no
    frequent line can skew. A null source is no site.
    """
    margin = max(1, math.ceil(6 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    lines = _lines(docs)
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc_id", "rid", "pos")).alias("first"))
    counted = sketched.select("key", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin)
    spread = scratch.save(counted, "spread")
    near = spread.filter(F.col("sites") < min_sites + margin)
    exact = lines.join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("exact"))
    settled = spread.join(exact, "key", "left").filter(F.coalesce("exact", "sites") >= min_sites)
    return scratch.save(settled.select("key", "first", F.coalesce("exact", "sites").alias("sites")), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """All rows of docs, their text without boilerplate lines, and n_lines, n_removed.

    docs has doc_id, text, source. A line counts without blanks around it; blank lines always stay.
    A boilerplate line stays where it first occurs (smallest doc_id, then position), so that no text
    vanishes from the corpus. Null text stays null with 0 lines; empty text has one blank line. Rows
    that are equal in doc_id and text get the same decision; a null doc_id counts as the smallest. An
    empty table gives an empty one. Other columns pass through, whatever their names; columns named
    n_lines or n_removed are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    id_, rid, removed = fresh(docs, "of_doc", "rid", "removed")
    found = boilerplate(docs, scratch, min_sites, lg_k)
    hits = _lines(docs).join(found.select("key", "first"), "key").filter(~F.struct("doc_id", "rid", "pos").eqNullSafe(F.col("first")))
    hits = hits.groupBy(F.col("doc_id").alias(id_), F.col("rid").alias(rid)).agg(F.collect_set("pos").alias(removed))
    lines = F.split("text", "\n", -1)
    everything = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(everything, F.col(removed)), lambda i: F.element_at(lines, i + 1))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(rid))
    return (
        docs.join(hits, same, "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
        .withColumn("n_removed", F.coalesce(F.size(F.array_intersect(everything, F.col(removed))), F.lit(0)))
        .withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop(id_, rid, removed)
    )
