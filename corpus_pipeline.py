"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as
Parquet and reads them again for the next. All stages but the last return the columns of documents,
and keep further ones, whatever their names. An empty table passes through all stages as an empty one;
texts are worked through whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import ngram_join, packing, pii, quality_rules, suffix_dedup
from quarrylight.llm._shared import shared_folder
from quarrylight.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go.

    Null and empty texts have no words and so are rejected. Repeated rows and rows of null doc_id are
    judged like others, by their text alone; rules are learned from a bounded sample of the labels, of
    which null ones are left out; without labels only the base rules count.
    """
    return quality_rules.keep(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id stays.

    Rows of null doc_id stay, as do null and empty texts, which are linked with nothing. Repeated rows
    of the doc_id that stays all stay: a doc_id, not a row, is what a group keeps, so there are no ties.
    """
    return ngram_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of the texts.

    Null texts stay null and texts of which nothing is left become empty; no row goes. Rows of one
    doc_id aren't compared with each other, rows of null doc_id with none.
    """
    return suffix_dedup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced.

    Null and empty texts stay as they are; repeated rows are changed alike, and rows of null doc_id
    like others. A term that tells of several values goes by the one of which it tells most.
    """
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences.

    A null or empty text is one piece, the end marker; repeated rows are packed as often as they occur;
    a null doc_id stays null; pieces of equal length go by doc_id, start and checksum.
    """
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL can't express the learned rules, the transitive groups, the substring matches or the tokenizer;
#: tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stages are written below the session's shared checkpoint folder, which the cluster clears."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
