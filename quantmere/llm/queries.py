"""The registered queries opN_<name>: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import quality_filter

    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_table

    docs = table(spark, sf_dir, "documents")
    return token_table(docs, tokenizer_path(), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import CnnConfig, fit_toxicity, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    config = CnnConfig()
    scored = score_toxicity(docs, fit_toxicity(docs, labels, config))
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", config.held_out_mod) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "rejected",
    )


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_mix_sources, op3_main_text, op4_licenses, op5_decontaminate, op6_quality, op7_context_tree, op8_token_ids, op9_toxicity, op10_exact_top_k)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
  i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
  places AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM wins) s, unnest(range(1, greatest(len(w) - n + 2, 1))) t(p)),
  hits AS (SELECT rid, p, n, item_id FROM places JOIN wins USING (n, g)),
  words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) t(q) GROUP BY rid),
  items AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q, v c
  WHERE q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
