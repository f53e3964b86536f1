"""The registered queries of this subpackage (opN_<name>) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.llm.urls import FETCH_SQL, URL_KEY_SQL


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.warc import capture_index

    index = capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "fetched", "capture_order")


OP2_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS largest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to,
  coalesce({URL_KEY_SQL}, '') AS url_key, {FETCH_SQL}::BIGINT AS fetched,
  row_number() OVER (ORDER BY encode(coalesce({URL_KEY_SQL}, '')), {FETCH_SQL}, page_id NULLS FIRST) - 1 AS capture_order
FROM r"""


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.audio import audio_features

    return audio_features(table(spark, sf_dir, "documents"))


def op5_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.urlfilter import default_list, filter_pages

    return filter_pages(table(spark, sf_dir, "pages"), default_list(spark))


def op6_lexicon_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.lexicon import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_ngram_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.quality import quality

    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.pii import pseudonyms, session_key

    done = pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return done.select("row.doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), "kinds")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.jaccard import Spec, jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), Spec(k=4, num=85, den=100)).documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_id": op1_language_id, "op2_warc_index_merge": op2_warc_index_merge, "op3_context_mixing": op3_context_mixing, "op4_audio_features": op4_audio_features, "op5_temporal_url_filter": op5_temporal_url_filter, "op6_lexicon_transducer_bpe": op6_lexicon_transducer_bpe, "op7_ngram_ratio_quality": op7_ngram_ratio_quality, "op8_best_two_fit_packing": op8_best_two_fit_packing, "op9_feistel_pseudonyms": op9_feistel_pseudonyms, "op10_ngram_jaccard_join": op10_ngram_jaccard_join}


def oracle_sql() -> dict[str, str]:
    from ledgerloom.llm import urlfilter

    return {"op2_warc_index_merge": OP2_SQL, "op5_temporal_url_filter": urlfilter.oracle()}
