"""Registered queries of the package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import op1_quality, op2_html, op3_minhash, op4_mixing, op5_pieces, op6_topk, op7_urls, op8_tokens, op9_licenses, op10_language, op11_decontamination, op12_whitening, op13_trie
from tidemark.llm.common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality.repetition_quality(read(spark, sf_dir, "documents"))


def op2_host_consensus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_html.extract_main_text(read(spark, sf_dir, "pages"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing.raked_mixture(read(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the encodings: counts, a hash of the ids in order, round trip."""
    return (op5_pieces.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path(op5_pieces.MODEL))
            .selectExpr("doc_id", "n_tokens", "n_chunks", "xxhash64(ids) as ids_hash", "round_trip"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_topk.exact_top_k(read(spark, sf_dir, "embeddings"), every=20)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_urls.url_verdicts(read(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_tokens.token_counts(read(spark, sf_dir, "documents"), tokenizer_path(op8_tokens.TOKENIZER))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_licenses.license_scan(read(spark, sf_dir, "documents"))


def op10_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_language.language_mix(read(spark, sf_dir, "documents"))


def op11_decontamination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_decontamination.contamination_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (op12_whitening.whiten(read(spark, sf_dir, "embeddings"))
            .selectExpr("vec_id", "component", "n", "try_cast(deviation as bigint) as deviation", "whitened",
                        "explained", "identity_error"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_repetition_quality, op2_host_consensus_text, op3_minhash_dedup, op4_raked_mixture, op5_sentencepiece, op6_exact_topk, op7_url_filter, op8_token_counts, op9_license_scan, op10_language_mix,
    op11_decontamination_hits, op12_cholesky_whitening, op13_prefix_trie,
)}

ORACLES = {
    "op4_raked_mixture": op4_mixing.raked_mixture_sql(),
    "op6_exact_topk": op6_topk.exact_top_k_sql(every=20),
    "op7_url_filter": op7_urls.url_verdicts_sql(),
    "op9_license_scan": op9_licenses.license_scan_sql(),
    "op11_decontamination_hits": op11_decontamination.contamination_sql(),
}
