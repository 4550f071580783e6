"""Training-corpus pipeline: ``documents`` to packed token sequences.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows that its predecessor kept; ``run`` writes what a stage
returns as Parquet under the shared scratch folder and reads it again as the next one's input, so that a lost executor
never costs more than the stage at work. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, language_id, line_dedup, packing, simhash
from ledgerlens.llm.common import id_remainder, stored, table


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: NULL texts and texts without letters go."""
    labelled = table(spark, sf_dir, "documents").where(id_remainder(F.col("doc_id"), 4) != 2)
    model = language_id.learn(labelled)
    rows = docs.select(F.struct("*").alias("row"), language_id.predict(spark, model, F.col("text")).alias("found"))
    return (rows.where(F.col("found.lang") != language_id.UNDETERMINED)
            .select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents hold; ``n_chars`` follows the text."""
    return line_dedup.deduplicate_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the least id."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", detect_language),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Language mixtures, SimHash components and token ids are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
