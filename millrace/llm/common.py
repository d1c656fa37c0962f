"""Shared folder, written intermediate tables and small helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts use it; words are the runs of other characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Columns of ``with_row`` that tell documents apart.
ROW = ("no_id", "did", "th")
#: Rows of texts that an executor holds at once as Arrow vectors, and again as Python objects.
TEXTS = 512
_PLAIN = {"parquet.enable.dictionary": "false", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, a temporary one serves a local master; a cluster needs a shared one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches have ``rows`` rows at most meanwhile; fewer stay as they are set (zero or less: without a bound)."""
    old = spark.conf.get(_BATCH)
    if rows is None or 0 < int(old) <= rows:
        yield
        return
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def written(df: DataFrame, name: str, batch: int | None = None, plain: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and outlives any executor. Its Python steps get batches of ``batch`` rows at most.

    ``plain`` is for hashes and ids, for which the writer would build dictionaries in vain."""
    path = scratch(df.sparkSession, name)
    with _batches(df.sparkSession, batch):
        df.write.options(**_PLAIN if plain else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Runs of other characters than ASCII white space; null: 0. Where single blanks and line ends part all words, these are counted, which is faster than a pattern."""
    ends = [side(text, F.lit(c)) for side in (F.startswith, F.endswith) for c in (" ", "\n")]
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in ("\t", "\r", "\x0b", "\x0c", "  ", " \n", "\n ", "\n\n")] + ends + [text == ""])
    parted = F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return F.coalesce(F.when(odd, F.regexp_count(text, F.lit(WORD))).otherwise(parted), F.lit(0)).cast("long")


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``no_id``, ``did`` and ``th``: rows of one id and one text are one document; a null id comes last and goes by its text."""
    return docs.withColumns({"no_id": F.col("doc_id").isNull(), "did": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "th": F.xxhash64(F.coalesce("text", F.lit("")))})


def keep_first(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``rooted(no_id, did, th, root)``: that of the smallest doc_id, nulls last, then of the smallest text hash."""
    first = rooted.groupBy("root").agg(F.min(F.struct(*ROW)).alias("o")).select("o.*")
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", "text")
    return with_row(slim).join(first, list(ROW), "left_semi").dropDuplicates(list(ROW)).select("own.*")
