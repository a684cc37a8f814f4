"""A corpus from documents to packed sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into the shared
folder and gives the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarifa.llm import mixing, packing, simhash, suffix_dedup, toxicity
from tarifa.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the classifier learns from the labelled rows of ``docs``; rows it calls toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on five-word shingles, verified at Jaccard similarity 0.8: one document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: repeated strings of 100 bytes go; what is left of a text stays, n_chars follows."""
    return suffix_dedup.with_lengths(suffix_dedup.deduplicate(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: rows repeat, or go, as the target weights of their sources ask."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a row per piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("suffix_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
