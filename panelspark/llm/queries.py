"""The registered queries of this subpackage, each over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, hard_negatives, html_extract, jaccard_join, lang_id, line_dedup, packing, quality, substring_dedup, topk, warc, whitening


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lang_id.identify(docs, lang_id.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    neighbours = quality.train(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.classify(docs, neighbours).select("doc_id", "held_out", "score", "predicted")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(rows, rows.filter(F.col("vec_id") % 50 == 0))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_byte_bpe, op3_embedding_dedup, op4_jaccard_join, op5_html_extract, op6_substring_dedup, op7_packing, op8_lang_id,
        op9_quality, op10_topk_search, op11_warc, op12_whitening, op13_hard_negatives,
    )
}

ORACLES = {
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach AS (
          SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION
          SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), part AS (
          SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), degree AS (
          SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
        )
        SELECT p.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, p.component_id, p.vec_id = p.component_id AS kept
        FROM part p LEFT JOIN degree d ON p.vec_id = d.vec_id
    """,
    "op6_substring_dedup": """
        WITH words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), windows AS (
          SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM words WHERE len(w) >= 13
        ), keyed AS (
          SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS win FROM windows
        ), firsts AS (
          SELECT win, min(doc_id) AS first FROM keyed GROUP BY win
        ), covered AS (
          SELECT DISTINCT k.doc_id, k.pos + o.o AS pos
          FROM keyed k JOIN firsts f ON k.win = f.win AND f.first < k.doc_id, (SELECT unnest(range(0, 13)) AS o) o
        ), gone AS (
          SELECT doc_id, list(pos) AS gone, count(*) AS n FROM covered GROUP BY doc_id
        ), kept AS (
          SELECT d.doc_id, len(d.w) AS n_words, coalesce(g.n, 0) AS n_removed,
                 CASE WHEN g.n IS NULL THEN d.w
                      ELSE list_transform(list_filter(range(1, len(d.w) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: d.w[i]) END AS w
          FROM words d LEFT JOIN gone g ON d.doc_id = g.doc_id
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(w, ' '), '')) AS kept_sha256 FROM kept
    """,
    "op1_line_dedup": """
        WITH split AS (
          SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
        ), line AS (
          SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
        ), spread AS (
          SELECT trim(line) AS line, min(doc_id) AS doc_id, min(pos + doc_id * 10000000) AS first
          FROM line WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT source) >= 10
        ), marked AS (
          SELECT l.doc_id, l.pos, l.line, (s.line IS NOT NULL AND l.pos + l.doc_id * 10000000 <> s.first) AS gone
          FROM line l LEFT JOIN spread s ON trim(l.line) = s.line
        ), kept AS (
          SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
          FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines,
               CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed,
               CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op10_topk_search": """
        WITH usable AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
          SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
    "op13_hard_negatives": """
        WITH usable AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
          FROM usable a JOIN usable c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
        ), positive AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), negative AS (
          SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
          WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
    """,
}
