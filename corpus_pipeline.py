"""The corpus pipeline: quality, repeated passages, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run()
writes what a stage returns as Parquet in the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.jaccard_join import kept_documents
from lectern.llm.line_dedup import without_repeated_lines
from lectern.llm.packing import pack
from lectern.llm.quality import accepted
from lectern.session import ship, table
from lectern.storage import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts have a score like any other; rows with one doc_id and text go together; a null doc_id is not learnt
    from; without usable labels all stay; an empty table stays empty; columns of any names go along.
    """
    ship(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three-line passages stay where they occur first; documents of which nothing is left go.

    Null and empty texts stay as they are, as do rows with a null doc_id; rows that repeat a doc_id stand at one place, so
    none of them gives way to another; columns of any names go along, and n_chars follows the text.
    """
    ship(spark)
    return without_repeated_lines(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays.

    Rows with a null doc_id, and texts without words, stay; rows that repeat the smallest doc_id all stay; columns of any
    names go along.
    """
    ship(spark)
    return kept_documents(docs, shingle=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens.

    A null or empty text is one token, the end; every row is packed by itself, whether its doc_id is null or repeats; pieces
    of one length are interchangeable and go by doc_id; an empty table gives no sequence; other columns aren't read.
    """
    ship(spark)
    return pack(docs, tokenizer=TOKENIZER, capacity=4096)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(f"stage{k - 1}")
    return docs
