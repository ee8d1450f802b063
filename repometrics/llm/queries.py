"""Registered queries of the numbered operators, over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import collocations, exact_dedup, merkle, ngram_join, oracles, packing, piece_codec, piece_counts, quality, simhash, substring_dedup, suffix_dedup, token_files, url_filter


def vocabulary_path(name: str) -> str:
    """A public vocabulary file; jobs that have their own pass its path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_with_edited(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    files = token_files.write_tokens(documents(spark, sf_dir), folder, vocabulary_path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return token_files.read_tokens(spark, files)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), size=100)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(documents(spark, sf_dir), size=5, threshold=0.8)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), size=13)


URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(pages(spark, sf_dir), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    return merkle.verify(docs, tampered, F.replace(docs["text"], F.lit("\n"), F.lit("")), fanout=3)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=30, inside=80, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash": op2_simhash,
    "op3_token_files": op3_token_files,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_piece_codec": op10_piece_codec,
    "op11_merkle": op11_merkle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.quality_rules(quality.MEASURES, quality.SHARES, quality.REACH, quality.GAMMA),
    "op4_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op5_ngram_join": oracles.NGRAM_JOIN,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_url_filter": oracles.url_filter(URL_RULES),
    "op11_merkle": oracles.MERKLE,
    "op12_exact_dedup": oracles.EXACT_DEDUP,
    "op13_collocations": oracles.COLLOCATIONS,
}
