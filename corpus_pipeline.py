"""A corpus from raw documents to packed sequences, in five stages; each works on all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, line_dedup, mixing, packing, simhash
from millrace.llm.common import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognisable language (no letter, or null) go; ``lang`` becomes the predicted one. Repeated rows stay; an empty table stays empty."""
    return langid.known_language(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-copies of lines go; ``n_chars`` follows the text. Documents stay, with fewer lines or none; null ids come last."""
    return line_dedup.dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, nulls last.

    Groups are joined by SimHash fingerprints within 2 bits and by five-word shingles of similarity 0.8 or more; texts without a word are one group.
    """
    return simhash.keep_one_of_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's share asks for, from none to three; null is a source, and rows alike are taken one by one."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence that they lie in; texts without a word are one empty piece, and ids stay whole numbers."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language models, components of near copies and Newton's iterations have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
