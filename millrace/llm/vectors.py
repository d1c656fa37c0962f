"""What the vector searches share: valid vectors, one length, and candidates and queries dealt into bounded blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vectors: DataFrame, not_zero: bool) -> DataFrame:
    """``(vec_id, x array<double>)`` of the rows that take part: no null vector, no null or non-finite component, and no null id.

    Shorter vectors count as filled up with zeros, which leaves inner products and cosines as they are.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), fine.alias("fine")).where("vec_id is not null and x is not null and fine")
    return (out.where(F.exists("x", lambda v: v != 0)) if not_zero else out).select("vec_id", "x")


def widest(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("x"))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column as rows of doubles, filled up to ``dim``."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(size) and (size == dim).all():
        return np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    out = np.zeros((len(size), dim))
    for k, part in enumerate(np.split(np.asarray(flat, dtype=np.float64), np.cumsum(size)[:-1])) if len(size) else ():
        out[k, : len(part)] = part
    return out


def block(key: Column, rows: Column, bound: int, salt: str) -> Column:
    """A number from 0 that splits the ``rows`` rows of a key into blocks of about ``bound``."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.greatest(F.lit(1), F.ceil(rows / bound)).cast("long")).cast("int")


def best_per_query(found: DataFrame, k: int, score: str) -> DataFrame:
    """The ``k`` best rows of ``found(query_id, vec_id, <score>)`` by falling score, then vec_id, with their ``rank``.

    Rows of one query are few: blocks have each given their ``k`` best. Sorting goes by a bounded array a query.
    """
    pair = F.struct((-F.col(score)).alias("down"), F.col("vec_id").alias("vec_id"))
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(pair)), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias(score))
