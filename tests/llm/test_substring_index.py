"""The durable index: batches against one brute-force pass, other sessions, compaction that is read, texts that aren't."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, words

from panelspark.llm import substring_index
from panelspark.llm.substring_index import SubstringIndex


def brute(texts, order):
    """Kept text and number of removed words of each text: windows of 13 words that start in an earlier one of order go."""
    first, found = {}, {}
    split = [WORDS.findall(t) if t else [] for t in texts]
    for place, i in enumerate(order):
        for p in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][p : p + 13]), place)
    for place, i in enumerate(order):
        gone = set()
        for p in range(len(split[i]) - 12):
            if first[tuple(split[i][p : p + 13])] < place:
                gone.update(range(p, p + 13))
        found[i] = (" ".join(w for p, w in enumerate(split[i]) if p not in gone), len(split[i]), len(gone))
    return found


@pytest.fixture()
def texts():
    rng = np.random.default_rng(9)
    shared = [words(40, 100 + i) for i in range(12)]
    out = []
    for i in range(240):
        parts = [words(int(rng.integers(5, 60)), 1000 + i)]
        for j in rng.integers(0, 12, int(rng.integers(0, 3))):
            a = int(rng.integers(0, 20))
            parts.append(shared[j][a : a + int(rng.integers(8, 40))])
        out.append(" ".join(w for p in parts for w in p))
    out[50] = out[7]
    out[200] = out[7]
    out[201] = " ".join(shared[0] * 30)  # a passage that repeats inside a text
    out[100], out[101] = None, ""
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "slot", "n_words", "rid", "windows")})


def test_batches_equal_one_pass(spark, texts, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    order = [*range(60, 120), *range(60), *range(120, 240)]  # a batch of smaller ids comes later
    want = brute(texts, order)
    found, read = {}, []
    real = substring_index.SubstringIndex._read
    monkeypatch.setattr(substring_index.SubstringIndex, "_read", lambda self, name: read.append(name) or real(self, name))
    SubstringIndex.create(spark, folder, buckets=8)
    compacted = set()
    for low in (60, 0, 120, 180):
        index = SubstringIndex.open(spark.newSession(), folder)  # nothing but the folder is known
        del read[:]
        batch = frame(index.spark, [(i, texts[i]) for i in range(low, low + 60)])
        for r in index.add(batch).collect():
            found[r["doc_id"]] = (r["text"], r["n_words"], r["n_removed"])
        if low == 120:
            assert compacted and compacted <= set(read)  # the run that two batches were merged into is what the third meets
        compacted = {name for level, name in index.runs if level > 0}
    assert found == want and sum(g for *_, g in want.values()) > 1000
    index = SubstringIndex.open(spark, folder)
    assert [level for level, _ in index.runs] == [2]
    index.clean()
    assert len(glob.glob(f"{folder}/run-*")) == 1 and len(glob.glob(f"{folder}/manifest-*")) == 1
    again = SubstringIndex.open(spark, folder).add(frame(spark, [(900, texts[7]), (901, "new " * 3)])).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in again} == {900: ("", len(WORDS.findall(texts[7]))), 901: ("new new new", 0)}


def test_odd_batches(spark, tmp_path):
    folder = str(tmp_path / "it's an index")
    index = SubstringIndex.create(spark, folder, buckets=4)
    text = " ".join(words(30, 1))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text + " more"), (5, "x" * 100_000)]
    found = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in index.add(frame(spark, rows)).collect()]
    assert sorted(found, key=repr) == sorted([(1, 30, 0), (1, 30, 0), (None, 30, 0), (2, 0, 0), (3, 0, 0), (4, 31, 30), (5, 1, 0)], key=repr)
    before = index.runs
    assert index.add(frame(spark, rows).limit(0)).count() == 0 and index.runs == before
    assert {r["n_removed"] for r in SubstringIndex.open(spark, folder).add(frame(spark, [(1, text)])).collect()} == {30}
    with pytest.raises(ValueError):
        SubstringIndex.create(spark, folder)
    with pytest.raises(ValueError):
        SubstringIndex.open(spark, str(tmp_path / "none"))


def test_a_batch_that_breaks_off_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    index = SubstringIndex.create(spark, folder, buckets=4)
    index.add(frame(spark, [(1, " ".join(words(30, 1)))]))
    monkeypatch.setattr(SubstringIndex, "_compacted", lambda self, runs: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(frame(spark, [(2, " ".join(words(30, 2)))]))
    monkeypatch.undo()
    again = SubstringIndex.open(spark, folder)
    assert again.number == 2 and len(again.runs) == 1 and len(os.listdir(folder)) == 4  # two manifests, and a run that no one names
    assert [r["n_removed"] for r in again.add(frame(spark, [(2, " ".join(words(30, 2)))])).collect()] == [0]
