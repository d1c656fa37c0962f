"""Exact top-k by integer inner product with pivot tables.

The distances of every vector to a few pivots bound its distance to a query from below, and so its inner product from above. A
cell (the rows nearest to a pivot) or a row whose bound lies under a query's ``k``-th best score is never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.vectors import best_per_query, block, matrix, valid, widest


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: the first is the row farthest from the mean, each next farthest from those before."""
    far = np.linalg.norm(sample - sample.mean(axis=0), axis=1)
    chosen = [int(far.argmax())]
    far = np.linalg.norm(sample - sample[chosen[0]], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def scan(query: np.ndarray, x: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int, own: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the ``k`` best rows, and how many rows were compared: in the order of falling bounds until none can get in."""
    order = np.argsort(-bound, kind="stable")
    best_id, best = np.zeros(0, dtype=np.int64), np.zeros(0)
    done = 0
    while done < len(order) and not (len(best) == k and bound[order[done]] < best[-1]):
        part = order[done : done + step]
        part = part[ids[part] != own]
        all_id, every = np.concatenate([best_id, ids[part]]), np.concatenate([best, x[part] @ query])
        top = np.lexsort((all_id, -every))
        _, first = np.unique(all_id[top], return_index=True)  # a repeated id counts once
        top = top[np.sort(first)][:k]
        best_id, best, done = all_id[top], every[top], done + step
    return best_id, best, min(done, len(order))


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, pivots: int = 24, sample: int = 4096, rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each row that ``is_query`` selects, among all others.

    Components are ``floor(1024 * x)``; they and the scores must stay under 2**53 (doubles then hold them exactly), otherwise the query raises. Ties
    go to the smaller vec_id; a repeated id counts once, with its best row. Pivots come from a bounded sample, the search is exact
    with any. First each query is compared with the blocks of its own cell; the ``k``-th score found there prunes cells and rows.
    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Empty table: empty result.
    """
    spark = vectors.sparkSession
    whole = valid(vectors, not_zero=False).withColumn("x", F.transform("x", lambda v: F.floor(v * 1024).cast("double")))
    dim = widest(whole)
    schema = "query_id long, rank int, vec_id long, score long"
    if not dim:
        return spark.createDataFrame([], schema)
    big = whole.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0.0
    if big * big * dim >= 2**53:
        raise ValueError("inner products don't fit into 2**53")
    n = whole.count()
    spot = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = whole.where(spot <= min(1.0, sample / n)).limit(2 * sample).collect() or whole.limit(sample).collect()
    table = np.zeros((len(some), dim))
    for i, r in enumerate(sorted(some, key=lambda r: r.vec_id)):
        table[i, : len(r.x)] = r.x
    shared = spark.sparkContext.broadcast(pivots_of(table, pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            d = distances(x, shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.argmin(1), pa.int32()), flat, pa.array((x**2).sum(1))], names=["vec_id", "x", "cell", "d", "square"])

    placed = written(whole.mapInArrow(place, "vec_id long, x array<double>, cell int, d array<double>, square double"), "topk-pivots")
    asked = placed.where(is_query)
    at = range(len(shared.value))
    ends = [f(F.col("d")[j]).alias(f"{name}{j}") for j in at for name, f in (("lo", F.min), ("hi", F.max))]
    # a row a cell, as many as pivots
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("square").alias("square"), *ends).toPandas()
    low, high = (cells[[f"{e}{j}" for j in at]].to_numpy() for e in ("lo", "hi"))
    of, most = cells["cell"].to_numpy(), cells["square"].to_numpy()
    per = spark.createDataFrame([(int(c), int(m)) for c, m in zip(of, cells["n"])], "cell int, n long")

    def pairs(queries: DataFrame) -> DataFrame:
        """Queries in blocks against the rows of their cells in blocks."""
        counted = queries.groupBy("cell").agg(F.count("*").alias("asked"))  # a row a cell
        sizes = F.broadcast(per.join(counted, "cell"))
        n_rows, n_asked = (F.greatest(F.lit(1), F.ceil(F.col(c) / m)).cast("int") for c, m in (("n", rows), ("asked", query_rows)))
        right = placed.join(sizes, "cell").select("cell", block(F.col("vec_id"), F.col("n"), rows, "row").alias("b"), F.explode(F.sequence(F.lit(0), n_asked - 1)).alias("a"), "vec_id", "x", "d", "square")
        left = queries.join(sizes, "cell").select(F.col("cell").alias("cell"), F.explode(F.sequence(F.lit(0), n_rows - 1)).alias("b"), block(F.col("query_id"), F.col("asked"), query_rows, "query").alias("a"), "query_id", "q", "qd", "qsquare", "least")

        def compare(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(have):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            fill = lambda col, width: matrix(pa.array(col.tolist(), pa.list_(pa.float64())), width)
            q, qd, x, d = fill(ask["q"], dim), fill(ask["qd"], len(at)), fill(have["x"], dim), fill(have["d"], len(at))
            ids, square, out = have["vec_id"].to_numpy(), have["square"].to_numpy(), []
            for i, (query, least) in enumerate(zip(ask["query_id"].to_numpy(), ask["least"].to_numpy())):
                gap = np.abs(d - qd[i]).max(axis=1)
                gap = np.maximum(gap - 1e-6 * (1 + gap), 0.0)  # rounding of the distances
                bound = (ask["qsquare"].iloc[i] + square - gap**2) / 2 + 1.0
                on = bound >= least
                found, score, _ = scan(q[i], x[on], ids[on], bound[on], k, query)
                out.append(pd.DataFrame({"query_id": query, "vec_id": found, "score": score.astype(np.int64)}))
            return pd.concat(out, ignore_index=True)

        keys = ["cell", "b", "a"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score long")

    base = asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.col("d").alias("qd"), F.col("square").alias("qsquare"), "cell")
    near = pairs(base.withColumn("least", F.lit(float("-inf"))))
    near = written(best_per_query(near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, "score"), "topk-near")
    least = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    ready = base.withColumnRenamed("cell", "home").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            qd, square, least_, home = matrix(col["qd"], len(at)), *(np.asarray(col[c].to_numpy(zero_copy_only=False)) for c in ("qsquare", "least", "home"))
            gap = np.maximum(np.maximum(low[None] - qd[:, None], qd[:, None] - high[None]).max(axis=2), 0.0)
            gap = np.maximum(gap - 1e-6 * (1 + gap), 0.0)
            bound = (square[:, None] + most[None] - gap**2) / 2 + 1.0
            i, j = np.nonzero((bound >= least_[:, None]) & (of[None] != home[:, None]))
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([*(col[c].take(take) for c in ("query_id", "q", "qd", "qsquare", "least")), pa.array(of[j], pa.int32())], names=["query_id", "q", "qd", "qsquare", "least", "cell"])

    kinds = "query_id long, q array<double>, qd array<double>, qsquare double, least double, cell int"
    rest = written(ready.select("query_id", "q", "qd", "qsquare", "least", "home").mapInArrow(aim, kinds), "topk-rest")
    far = pairs(rest).select("query_id", "vec_id", "score")
    both = near.select("query_id", "vec_id", "score").unionByName(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best_per_query(both, k, "score")
