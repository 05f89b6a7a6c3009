"""From raw documents to packed sequences: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import jaccard_join, lang_id, line_dedup, packing, substring_dedup
from panelspark.llm.queries import tokenizer_file
from panelspark.llm.runtime import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if the network has no language for it, or if its score is less than this part of the way from
#: chance, one by the number of languages, to certainty.
MIN_MARGIN = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the byte network recognises. Null, empty and letterless texts go; rows
    with a null doc_id, repeated rows and very long texts are judged like others. Without any label all go."""
    net = lang_id.train(docs)
    found = lang_id.identify(docs.select(COLUMNS), net)
    chance = 1 / max(len(net.langs), 1)
    sure = F.col("score") >= (chance + MIN_MARGIN * (1 - chance) if chance < 1 else 0.0)
    return found.filter((F.col("lang_pred") != lang_id.UNKNOWN) & sure).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines beyond their first occurrence; all documents stay, null texts as they are.
    Rows that are equal in doc_id and text lose the same lines."""
    return line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by similarity. Rows without an id, null and
    empty texts are linked with nothing and stay; repeated rows of a kept id all stay."""
    gone = jaccard_join.jaccard_join(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that a document with a smaller id has; documents that had nothing else go. Rows without
    an id lose nothing, a null text becomes empty, and repeated rows lose the same words."""
    kept = substring_dedup.remove_repeats(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of one window, with their ids as little-endian 32-bit integers. Null
    and empty texts have the end id alone; repeated rows and rows without an id are packed each for itself."""
    pieces = packing.pack(docs, tokenizer_file("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packed)]
#: Training and tokenization can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents; each result is written and read again, and removed when
    the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
