"""A training corpus from raw documents: quality, near duplicates, repeated passages, personal data, packing.

Every stage takes documents with any null, with empty and very long texts, with rows that repeat and with more columns,
which are left out; no documents give no rows. Each reads whole texts and all rows of what the stage before has kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import near_dedup, packing, pii, quality, substring_dedup
from siltbed.llm.common import by_size, forget, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Without usable labels all stay; each row is judged by its own text, a null one as empty."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays; rows without doc_id and texts without words stay."""
    gone = written(near_dedup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(by_size(gone), "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays, also those without doc_id, unchanged."""
    return substring_dedup.remove_repeated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become the names of their kinds; every document stays, and a null text stays null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 2048 tokens; a null text is as an empty one."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written, and read as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: classifiers, tokenizers and passages are beyond it. tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None
