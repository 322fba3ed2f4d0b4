"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphora.llm import bins, decontaminate, html_extract, licenses, quality, simhash, substring, tokens, topk, urls
from glyphora.llm._common import table


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    end = 50256  # the free id of this vocabulary
    return tokens.packed_rows(table(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents
), places AS (
  SELECT r, unnest(range(1, len(words) - 33)) AS p FROM w WHERE len(words) >= 35
), windows AS (
  SELECT r, p, array_to_string(words[p:p + 34], ' ') AS s FROM places JOIN w USING (r)
), again AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS k FROM again
), lost AS (
  SELECT r, count(*) AS n, list(k) AS ks FROM gone GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE
         [words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(ks, k)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (r)
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.pack(table(spark, sf_dir, "documents"), _tokenizer_file("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.classify(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.whole(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_dot_product(q.e, c.e), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_neardup": op1_simhash_neardup,
        "op2_token_rows": op2_token_rows,
        "op3_decontamination": op3_decontamination,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_html_extraction": op7_html_extraction,
        "op8_exact_topk": op8_exact_topk,
        "op9_license_scan": op9_license_scan,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op8_exact_topk": OP8_SQL}
