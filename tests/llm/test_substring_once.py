"""Substring dedup: texts are read for their windows once, and lookups and cuts of whole batches equal those of one text at a time."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import WORDS, words

from panelspark.llm import substring_dedup as S


def test_windows_are_made_once(spark):
    text = " ".join(words(40, 1))
    docs = spark.createDataFrame([(i, text if i else text + " end", i) for i in range(60)], "doc_id long, text string, rid long").coalesce(1)
    shared = docs.select("doc_id").crossJoin(spark.createDataFrame([(int(h),) for h in S._Runs([text]).fingerprint], "h long"))
    found = S._covered(docs, shared, F.col("doc_id") > 20)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_windows(") == 1
    reach = {}
    for r in found.collect():
        reach[r["doc_id"]] = reach.get(r["doc_id"], 0) + r["length"] * len(r["starts"]) // 4
    assert reach == {i: 28 for i in range(21, 60)}  # each of the windows once, settled in its piece or verified


def test_lookups_of_a_batch(spark):
    texts = [" ".join(words(60, i % 3)) for i in range(6)]
    runs = S._Runs(texts)
    own = [runs.fingerprint[runs.doc == i] for i in range(6)]
    wanted = [own[0][:3], own[2], None, np.zeros(0, np.int64), own[1][1:2], own[0]]
    want = [wanted[d] is None or h in wanted[d] for h, d in zip(runs.fingerprint, runs.doc, strict=True)]
    assert S._wanted(runs, wanted).tolist() == want and 0 < sum(want) < len(want)
    assert S._wanted(runs, [None] * 6).all() and not S._wanted(runs, [own[2][:0]] * 6).any()


def test_white_space_is_joined():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 400):
        text = "".join(rng.choice(list(" \t\n\v\f\rab\x1c\x85\xa0 é"), n))
        assert S._joined(text).decode() == " ".join(WORDS.findall(text))
    assert S._joined(None) == b""
