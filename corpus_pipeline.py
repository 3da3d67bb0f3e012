"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm._runs import shared_dir
from ledgerlake.llm.line_dedup import drop_lines
from ledgerlake.llm.parity_join import keep_one
from ledgerlake.llm.piece_lattice import encoded
from ledgerlake.llm.robust_rules import keep_good
from ledgerlake.llm.source_mix import mixed_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language and source go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least ten documents go from all of them; every document stays."""
    return drop_lines(docs, min_chars=1, min_docs=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the smallest doc_id stays."""
    return keep_one(docs, n=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights; a row for each document and copy that the mix takes."""
    return mixed_documents(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and the three best segmentations of each text of the mix: Viterbi forward, A-star backward."""
    return encoded(docs, n=3)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sentence_pieces", sentence_pieces),
]

#: The stages are held against brute force in tests/llm/test_corpus_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
