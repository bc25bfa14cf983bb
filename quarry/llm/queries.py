"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, embeddings, html, media, packing, quality, secrets, simhash, substring, tokenfile
from quarry.llm.common import table

END_ID = 2


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_quality": op2_quality,
    "op3_embeddings": op3_embeddings,
    "op4_media_columns": op4_media_columns,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_token_ids": op7_token_ids,
    "op8_html": op8_html,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_packing": op10_packing,
}

#: SQL of the operators that it can express; hashes of the others' definitions and trained models are beyond it.
ORACLE_SQL: dict[str, str] = {
    "op1_substring": r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split),
win AS (SELECT doc_id, p, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
least AS (SELECT seq, min(doc_id) AS doc_id FROM win WHERE n = 50 GROUP BY seq HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, p FROM win JOIN least USING (seq) WHERE n = 50 AND win.doc_id > least.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM hit),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
""",
    "op3_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least.b AS component_id, vec_id = least.b AS kept FROM v JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id
""",
}
