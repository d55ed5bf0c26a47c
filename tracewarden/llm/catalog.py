"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import decontamination, embedding_duplicates, filter_audit, licences, lm_scores, mixing, near_duplicates, packing, quality, source_divergence, tokencounts, tokenfiles, toxicity
from tracewarden.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, which is installed beside Python, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, by exact containment of its shingles."""
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that are a document's whole text, a paragraph or a line."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all vectors."""
    return embedding_duplicates.link(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all texts, and the spans that make it."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document, and whether it stays."""
    return near_duplicates.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all texts."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backed-off logarithms of all texts under the corpus's n-gram counts."""
    return lm_scores.score(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all texts."""
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token files, read back."""
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the vocabularies of each language's sources diverge, and by which terms."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of all their orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 4096 tokens."""
    return packing.pack_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_licences, op3_embedding_near_dedup, op4_toxicity, op5_minhash_near_dedup, op6_quality, op7_lm_scores, op8_token_counts, op9_token_files, op10_mix, op11_source_divergence, op12_filter_audit, op13_pack)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontamination.ORACLE, "op2_licences": licences.oracle(), "op7_lm_scores": lm_scores.ORACLE, "op11_source_divergence": source_divergence.ORACLE, "op12_filter_audit": filter_audit.oracle()}
