"""Rows and samples that must not lose any kind of row as tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import jaccard_join, lang_id, quality


def test_quality_has_the_ratio_of_labels_at_any_size(spark):
    docs = spark.createDataFrame([(i, f"some words number {i % 7}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(2000)], "doc_id long, quality int")
    whole, part = quality.train(docs, labels), quality.train(docs, labels, max_rows=400)
    assert len(part.labels) == 400 and part.prior == pytest.approx(whole.prior, abs=0.05) and whole.prior == pytest.approx(0.875, abs=0.03)
    assert part.score([""])[0] == part.prior and float(np.mean(part.labels)) > 0.8


def test_every_row_has_a_class(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, None), (1, ""), (2, text), (3, ""), (3, " \t\n"), (None, text), (None, None), (4, "\u3000"), (4, None), (1, text)]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found if r["doc_id"] in (1, 2)) == [(1, 1, 0)] * 2 + [(1, 1, 2)] * 2 + [(2, 1, 2)]
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in found if r["doc_id"] not in (1, 2))


def test_rare_languages_keep_all_their_windows(spark):
    """A hundred languages of which some have fewer windows than their share, for several ranges of ids."""
    for start in (0, 10_000_000):
        sizes = {f"l{i}": 3 + i % 40 * 4 for i in range(100)}
        rows = [(start + 1000 * i + j, f"{lang} text {j} " * 3, lang) for i, (lang, n) in enumerate(sizes.items()) for j in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        there = {r["lang"]: r["n"] for r in docs.filter(~lang_id.held_out()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
        sample = lang_id.training_sample(docs, 6000)
        found = sample["lang"].value_counts().to_dict()
        assert len(sample) <= 6000 and all(found[x] == n for x, n in there.items() if n <= 60) and all(n <= 60 for n in found.values())


def test_one_text_of_a_repeated_document(spark):
    docs = spark.createDataFrame([(i, f"some words number {i % 7}") for i in range(200)] + [(3, "other words")] * 2000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(200)], "doc_id long, quality int")
    found = quality.train(docs, labels)
    assert len(found.labels) == len(found.vectors) == labels.filter(~quality.held_out()).count()


def test_tokenizers_of_other_kinds_are_taken_whole():
    from tokenizers import Tokenizer

    from panelspark.llm import packing
    from panelspark.llm.queries import tokenizer_file

    texts = ["Hello World  and\n\ttabs, it's 2024!", "É'tat ünïcode 汉字 😀", "", None, "a" * 3000 + " B" * 10]
    for name, by_class in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = tokenizer_file(name)
        own, whole = packing.Encoder(path), Tokenizer.from_file(path)
        assert own.by_class is by_class
        for t in texts:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids
