"""The subpackage's queries: thin digests over the operators, each over its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.jaccard_join import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.compact_windows import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.bpe import encode_texts

    coded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.substring_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.decontamination import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hallkeeper.llm.lattice import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from hallkeeper.llm import oracles

    return oracles.oracle_sql()
