"""Mixing sources to target weights by entropy balancing.

Document rates ``r`` minimise ``sum(r log r - r)`` under ``0 <= r <= cap`` and, for each source, ``sum(r * size) = target``.
The convex dual has one variable a source; the rates are ``min(cap, exp(lambda * size / mean size))``. Newton steps, kept
inside a bracket, run on distributed sums; the rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import word_count, written


def _key() -> Column:
    """A null source is a source of its own; this joins it."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def targets_by_weight(sizes: dict[str | None, int], total: float, cap: float = 3.0) -> dict[str | None, float]:
    """Targets of sources by code point, null last, of weights 1, 2, 3 repeating; none over ``cap`` times its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    out, open_, left = {s: 0.0 for s in order}, {s for s in order if sizes[s]}, float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def _per_source(spark: SparkSession, rows: list[tuple], kinds: str) -> DataFrame:
    """A few numbers a source, to be joined by key; broadcast while they are at most 10,000 rows."""
    out = spark.createDataFrame(rows, kinds)
    return F.broadcast(out) if len(rows) <= 10_000 else out


def solve_rates(histogram: DataFrame, target: dict[str, float], size: dict[str, float], mean: dict[str, float], cap: float, rounds: int = 60, tol: float = 1e-6) -> dict[str, float]:
    """The dual variable of each source from ``histogram(key, size, n)``; every round is one distributed sum for all sources.

    Targets at the cap or at nothing have no finite solution and get an infinite one. A Newton step that leaves the bracket
    found so far is replaced by its middle, or by a doubled step where the bracket is still open.
    """
    lam = {k: math.log(max(target[k], 1e-300) / size[k]) for k in target if size[k] > 0}
    low, high, reach = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf), dict.fromkeys(lam, 1.0)
    spark, done = histogram.sparkSession, set()
    for k in list(lam):
        if target[k] >= cap * size[k] * (1 - 1e-12):
            lam[k] = math.inf
            done.add(k)
        elif target[k] <= 0:
            lam[k] = -math.inf
            done.add(k)
    for _ in range(rounds):
        if done >= set(lam):
            break
        now = _per_source(spark, [(k, lam[k], mean[k]) for k in lam if k not in done], "key string, lam double, mean double")
        x = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("lam") * x, F.lit(60.0)))
        w = F.col("n") * F.col("size")
        sums = (
            histogram.join(now, "key")
            .groupBy("key")
            .agg(F.sum(w * F.least(free, F.lit(cap))).alias("got"), F.sum(F.when(free < cap, w * free * x).otherwise(0.0)).alias("slope"))
            .collect()  # a row a source
        )
        for k, got, slope in sums:
            if abs(got - target[k]) <= tol * target[k]:
                done.add(k)
                continue
            low[k], high[k] = (lam[k], high[k]) if got < target[k] else (low[k], lam[k])
            step = lam[k] + (target[k] - got) / slope if slope > 0 else math.inf
            if not low[k] < step < high[k] or abs(step - lam[k]) > 4 * reach[k]:
                if math.isinf(low[k]) or math.isinf(high[k]):
                    step, reach[k] = lam[k] + math.copysign(reach[k], target[k] - got), 2 * reach[k]
                else:
                    step = (low[k] + high[k]) / 2
            lam[k] = step
    return lam


def fill(items: DataFrame, target: dict[str, float], start: float, width: float, cells: int = 512, passes: int = 3) -> tuple[dict[str, float], dict[str, float]]:
    """The largest threshold on ``items(key, at, size)`` for which each key's sizes below it sum up to no more than its target, and the sums.

    Each pass counts the sizes of ``cells`` equal steps of every key and goes on within the one that holds the threshold.
    """
    spark = items.sparkSession
    low, got = dict.fromkeys(target, start), dict.fromkeys(target, 0.0)
    for _ in range(passes):
        now = _per_source(spark, [(k, low[k]) for k in target], "key string, low double")
        cell = F.greatest(F.floor((F.col("at") - F.col("low")) * (cells / width)), F.lit(-1))
        rows = items.join(now, "key").select("key", cell.alias("cell"), "size").where(f"cell < {cells}").groupBy("key", "cell").agg(F.sum("size")).collect()
        found: dict[str, dict[int, float]] = {k: {} for k in target}
        for k, c, w in rows:  # at most ``cells`` + 1 rows a source
            found[k][c] = float(w)
        for k, cell_sums in found.items():
            total, at = cell_sums.get(-1, 0.0), 0
            while at < cells and total + cell_sums.get(at, 0.0) <= target[k]:
                total += cell_sums.get(at, 0.0)
                at += 1
            low[k], got[k] = low[k] + at * width / cells, total
        width /= cells
    return low, got


def mix(docs: DataFrame, cap: int = 3) -> DataFrame:
    """The table of :func:`copies_of` without what tells rows of a doc_id apart."""
    return copies_of(docs, cap).drop("key", "th", "nth")


def copies_of(docs: DataFrame, cap: int = 3) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` to ``(doc_id, size, source_size, target, taken, copies, key, th, nth)``, a row for each row.

    ``size``: words of ``text`` (null: 0). Targets: :func:`targets_by_weight` of 100 % of all sizes. ``copies`` is a whole
    number from 0 to ``cap``; ``taken = copies * size``. The ``k``-th copy of a document stands at ``k - rate - u``, ``u`` a hash of
    doc_id, text and, among rows alike in these, a running number; a source takes its copies up to a threshold, which distributed sums find so that the words taken come up to the
    target; what one long document leaves open is filled with shorter ones in the same order. Documents without words keep their
    one copy. Null is a source of its own, last. Repeated rows are rows like any other. An empty table gives an empty one. The
    driver holds a few numbers a source; it never holds documents.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", _key().alias("key"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    alike = slim.groupBy("doc_id", "key", "size", "th").agg(F.count("*").alias("n"))
    # rows alike in all of these are numbered; in two steps, so that no array grows with their number
    tens = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 10_000))).alias("ten"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(9_999), F.col("n") - 1 - F.col("ten") * 10_000)))
    numbered = tens.select("doc_id", "key", "size", "th", "ten", each.alias("one")).withColumn("nth", F.col("ten") * 10_000 + F.col("one"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "th", "nth", F.lit("mix")), 11) / F.lit(float(1 << 53))).alias("u")
    sized = written(numbered.select("doc_id", "key", "size", "th", "nth", u), "mix-sizes")
    histogram = written(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-histogram")
    of = histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()  # a row a source
    name = {k: None if k == "n" else k[1:] for k, _, _ in of}
    size = {k: float(w) for k, w, _ in of}
    by = targets_by_weight({name[k]: int(size[k]) for k in size}, sum(size.values()), float(cap))
    target = {k: by[name[k]] for k in size}
    mean = {k: max(w / n, 1e-9) for k, w, n in of}
    lam = solve_rates(histogram.where("size > 0"), target, size, mean, float(cap))

    rows = [(k, int(size[k]), target[k], float(lam.get(k, 0.0)), mean[k]) for k in size]
    rated = sized.join(_per_source(spark, rows, "key string, source_size long, target double, lam double, mean double"), "key").withColumn(
        "rate",
        F.when(F.col("lam") == math.inf, float(cap))
        .when(F.col("lam") == -math.inf, 0.0)
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(60.0))))),
    )
    spots = F.array(*[F.lit(k) - F.col("rate") - F.col("u") for k in range(1, cap + 1)])
    items = rated.where("size > 0").select("key", "size", F.explode(spots).alias("at"))
    low, got = fill(items, target, -1.0, float(cap) + 2)
    levels = [{k: (low[k], math.inf) for k in size}]
    for _ in range(2):
        most = {k: max(0.0, target[k] - got[k]) for k in size}
        prior = _per_source(spark, [(k, levels[-1][k][0], most[k]) for k in size], "key string, before double, most double")
        short = items.join(prior, "key").where("at >= before and size <= most")
        more, added = fill(short, most, -1.0, float(cap) + 2)
        levels.append({k: (more[k], most[k]) for k in size})
        got = {k: got[k] + added[k] for k in size}
    bounds = [(k, *[x for level in levels for x in level[k]]) for k in size]
    kinds = "key string, " + ", ".join(f"to{j} double, most{j} double" for j in range(len(levels)))

    def taken(k: int):  # noqa: ANN202
        at = F.lit(k) - F.col("rate") - F.col("u")
        return reduce(or_, [(at < F.col(f"to{j}")) & (F.col("size") <= F.col(f"most{j}")) for j in range(len(levels))]).cast("long")

    copies = F.when(F.col("size") == 0, 1).otherwise(reduce(add, map(taken, range(1, cap + 1)))).cast("long")
    out = rated.join(_per_source(spark, bounds, kinds), "key").withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "key", "th", "nth")


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs``, with columns of any names, with each row repeated as often as :func:`mix` says; rows of no copy go.

    Rows alike in doc_id, source and text are numbered in any order, and each takes the copies of its number.
    """
    same = ("doc_id", "key", "th")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", _key().alias("key"), F.xxhash64("text").alias("th"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))).cast("long") - 1)
    many = copies_of(docs).where("copies > 0").select(*[F.col(c).alias(f"its_{c}") for c in (*same, "nth")], "copies")
    meet = own.doc_id.eqNullSafe(many.its_doc_id) & (own.key == many.its_key) & (own.th == many.its_th) & (own.nth == many.its_nth)
    out = own.join(many, meet).select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("one"))
    return out.select("own.*")
