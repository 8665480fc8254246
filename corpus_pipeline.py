"""From raw documents to packed training sequences, in stages that each keep what the one before kept.

Documents that the quality rules reject go; of near-duplicates by five-word
shingles the one with the least doc_id stays; long repeats leave the texts of
the documents that hold them; sources are repeated or cut to their weights;
and the mixed documents are packed into sequences. All stages but the last
return the columns of documents, with n_chars renewed where a text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linegrain.llm import mixing, neardup, packing, quality, repeats
from linegrain.llm.common import pinned


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the bands of tokeniser fertility."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more."""
    return neardup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that also start elsewhere."""
    return _counted(repeats.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or cut to their weights."""
    return _counted(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", reject_bad),
    ("near_duplicates", drop_near_duplicates),
    ("repeat_removal", cut_repeats),
    ("source_mix", mix_sources),
    ("sequence_packing", pack_sequences),
]

#: Vocabularies, long repeats and a genetic algorithm cannot be said in SQL; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
