"""Corpus cleaning: toxicity, line dedup, near-dedup, mixing, packing.

Each stage reads all that its predecessor kept, as a table with the columns of
``documents``; the last returns the packed pieces.

Edge cases, by stage: a null text counts as empty and stays null up to packing,
where it is one end id; a text that loses all its lines stays as an empty one; a
row without doc_id is scored, deduplicated, mixed and packed like others; of
wholly repeated rows one keeps its lines, and near-dedup keeps one row a group;
a document of no words takes no place in the mix; without labelled rows of both
classes nothing counts as toxic; an empty table gives no pieces; extra columns
pass through all but the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumentrace.llm import common, curriculum, line_dedup, packing, simhash_groups, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; n_chars follows the text."""
    return line_dedup.clean_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_groups.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Compression lengths and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
