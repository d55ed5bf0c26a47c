"""A chain of training-text operators over ``documents``, each stage written as Parquet and read back.

All stages but the last keep the columns of their documents, whatever their names.  Null ids, texts and sources, empty
and very long texts, repeated rows and empty tables are rows like others:

* toxicity: null texts and texts without words score 0 and stay; rows with the same doc_id and text share one fate;
* near-duplicates: all texts without words are one group; one row of each group stays, so repeated rows become one;
* decontamination: texts of fewer than five words hold no item and stay;
* mixing: rows without words are taken by no slot and go; a null source is a source of its own;
* token files: a null text is the end id alone; null doc_ids come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import catalog, decontamination, mixing, near_duplicates, tokenfiles, toxicity
from tracewarden.llm.common import materialize, packed, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go; all rows with the same doc_id and text share that fate."""
    # the operator reads nothing but doc_id and text
    scored = toxicity.score(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), keep_text_hash=True)
    bad = materialize(scored.where("predicted = 1").select("row_hash").distinct(), "toxic")
    keyed = docs.select(packed(docs).alias("d"), F.xxhash64("doc_id", "text").alias("row_hash"))
    return keyed.join(bad, "row_hash", "left_anti").select("d.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_duplicates.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document taken several times is several rows."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, and what they hold for each row."""
    return tokenfiles.round_trip(docs, catalog.vocabulary("byte_bpe_50k.json"), 2)


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token files", token_files),
]

#: No SQL can express these models, sketches and draws; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
