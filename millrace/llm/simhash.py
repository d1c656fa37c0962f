"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated fingerprint bits are grouped into parts; each fingerprint gets its own thresholds per part, chosen by dynamic
programming on candidate counts estimated from all fingerprints, and probes the parts' index with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, TEXTS, keep_first, with_row, written
from millrace.llm.components import connected_components
from millrace.llm.near_copies import near_copies

BITS, SKETCH = 64, 1 << 16
_ONE = np.uint64(1)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash, unsigned: ASCII-lower-cased words, 3-word shingles with repeats, XXH64 of seed 42, strict majority.

    Null or empty text: 0. Fewer than three words: the whole sequence is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    count = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), 65536):
        part = shingles[at : at + 65536]
        hashes = np.fromiter((digest(x, 42) for x in part), dtype="<u8", count=len(part))
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp long)`` of every row; a long holds the unsigned fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def _spread(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together, over all fingerprints: 64 x 64, the number of rows in the last row's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, BITS + 1), dtype=np.float32)
            x[:, :BITS] = _spread(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    out = np.zeros((BITS + 1, BITS + 1))
    for i, j, n in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n  # 65 x 65 rows, whatever the input
    return out


def group_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width; each takes up the bits that correlate most with those it has."""
    n = max(together[BITS, BITS], 1.0)
    p = together[BITS, :BITS] / n
    cov = together[:BITS, :BITS] / n - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0.0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups)) + parts - k - 1) // (parts - k)
        at = max(sorted(free), key=lambda b: max((corr[b, c] for c in free), default=0.0))
        group = [at]
        free.discard(at)
        while len(group) < width:
            at = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(at)
            free.discard(at)
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    out = []
    for group in groups:
        v = np.zeros(len(fps), dtype=np.uint64)
        for k, bit in enumerate(group):
            v |= ((fps >> np.uint64(bit)) & _ONE) << np.uint64(k)
        out.append(v)
    return out


def _bucket(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def candidate_sketch(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Counts of hashed part values over all fingerprints, ``parts x 65536``: a bound from above for each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), SKETCH), dtype=np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, v in enumerate(part_values(fp, groups)):
                total[k] += np.bincount(_bucket(v), minlength=SKETCH)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    out = np.zeros((len(groups), SKETCH), dtype=np.int64)
    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["n"].to_numpy()
    return out


def allocate(fps: np.ndarray, groups: list[list[int]], sketch: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the thresholds per part (-1: not probed) and what they cost in probes and candidates.

    General pigeonhole: the thresholds plus one sum up to ``tau + 1``. Dynamic programming over the parts finds, for
    each sum, the cheapest choice among -1, 0 and 1 a part.
    """
    n, values = len(fps), part_values(fps, groups)
    best = [np.zeros(n)] + [np.full(n, np.inf)] * (tau + 1)
    chosen: list[list[np.ndarray]] = []
    for k, group in enumerate(groups):
        same = sketch[k][_bucket(values[k])].astype(float)
        near = same.copy()
        for bit in range(len(group)):
            near += sketch[k][_bucket(values[k] ^ (_ONE << np.uint64(bit)))]
        cost = {-1: np.zeros(n), 0: 1 + same, 1: 1 + len(group) + near}
        step, took = [], []
        for total in range(tau + 2):
            options = [(t, best[total - t - 1] + c) for t, c in cost.items() if total - t - 1 >= 0]
            least = np.argmin(np.stack([c for _, c in options]), axis=0)
            step.append(np.choose(least, [c for _, c in options]))
            took.append(np.array([t for t, _ in options])[least])
        best = step
        chosen.append(took)
    left, out = np.full(n, tau + 1), np.zeros((n, len(groups)), dtype=np.int64)
    for k in range(len(groups) - 1, -1, -1):
        out[:, k] = np.choose(left, chosen[k])
        left = left - out[:, k] - 1
    return out, best[tau + 1]


def links(fps: DataFrame, tau: int = 2, parts: int = 3, dense: int = 64) -> DataFrame:
    """``(a, b)`` pairs of distinct fingerprints (column ``fp``, each once) whose connection equals that of all pairs within ``tau`` bits.

    Fingerprints whose cheapest thresholds are estimated to cost over ``dense`` lie in a crowd; their links to others are
    found when those probe, and those among themselves by the values within one bit of both (``tau`` = 2), of which none
    has over 65 neighbours: no group in a crowd is compared pair by pair, and no link is lost.
    """
    if tau != 2:
        raise ValueError("links are defined for tau = 2")
    groups = group_bits(bit_statistics(fps), parts)
    sketch = candidate_sketch(fps, groups)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, v in enumerate(part_values(fp, groups)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, dtype=np.int32)), pa.array(v.view(np.int64)), pa.array(fp.view(np.int64))], names=["part", "value", "b"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            t, cost = allocate(fp, groups, sketch, tau)
            crowd = cost > dense
            for k, v in enumerate(part_values(fp, groups)):
                for flip in [None, *range(len(groups[k]))]:
                    on = ~crowd & (t[:, k] >= (0 if flip is None else 1))
                    if on.any():
                        w = v[on] if flip is None else v[on] ^ (_ONE << np.uint64(flip))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), k, dtype=np.int32)), pa.array(w.view(np.int64)), pa.array(fp[on].view(np.int64))], names=["part", "value", "a"])
            if crowd.any():
                rest = fp[crowd]
                for flip in [None, *range(BITS)]:
                    w = rest if flip is None else rest ^ (_ONE << np.uint64(flip))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), -1, dtype=np.int32)), pa.array(w.view(np.int64)), pa.array(rest.view(np.int64))], names=["part", "value", "a"])

    slim = fps.select("fp")
    probed = slim.mapInArrow(probes, "part int, value long, a long")
    normal = probed.where("part >= 0").join(slim.mapInArrow(index, "part int, value long, b long"), ["part", "value"])
    normal = normal.where("a <> b and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = probed.where("part = -1").groupBy("value").agg(F.min("a").alias("a"), F.collect_list("a").alias("all"))
    crowded = crowded.where("size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b")
    return normal.unionByName(crowded)


def _rooted(of: DataFrame) -> DataFrame:
    """``(fp, least, root)`` of each distinct fingerprint of ``of(doc_id, fp, ...)``; ``root`` is a fingerprint of its component."""
    fps = written(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(fps))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return written(rooted, "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text, ...)``.

    Rows link at two or fewer differing bits; ``component_id`` is the smallest doc_id reachable. Null and empty texts have
    fingerprint zero and link like any other. Null doc_ids stay and never name a component with other ids. Repeated rows
    stay repeated. Other columns are ignored. An empty table gives an empty one.
    """
    of = written(fingerprints(docs), "fingerprints")
    named = _rooted(of)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return of.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _of_rows(docs: DataFrame) -> DataFrame:
    """``(no_id, did, th, root)`` of every document, see ``with_row``; ``root`` is a fingerprint of its component."""
    rows = with_row(docs.select("doc_id", "text"))
    prints = fingerprints(rows.select(F.struct(*ROW).alias("doc_id"), "text"))
    of = written(prints, "fingerprints", TEXTS)
    return of.join(_rooted(of), "fp").select("doc_id.*", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, nulls last, then of the smallest text hash.

    Components are told apart by their fingerprints, not by ids: different texts under one id, or under none, each stay.
    """
    return keep_first(docs, _of_rows(docs))


def keep_one_of_copies(docs: DataFrame) -> DataFrame:
    """``docs``, with columns of any names, with one row of each group of near copies, chosen as in :func:`keep_one`.

    Groups are joined by fingerprints within 2 bits, and by a similarity of 0.8 or more of five-word shingles, which 64 bits alone can't tell (at 0.8
    some 10 differ, so that most links would be missed or unrelated texts met). Null and empty texts are one group. An empty table gives an empty one.
    """
    near, prints = near_copies(docs), _of_rows(docs).distinct().withColumnRenamed("root", "print")
    both = written(near.distinct().join(prints, list(ROW)), "near-and-prints")
    least = both.groupBy("print").agg(F.min("root").alias("a"))
    edges = both.select("print", F.col("root").alias("b")).distinct().join(least, "print").where("a <> b").select("a", "b")
    merged = connected_components(written(edges, "merged-edges"))
    rooted = both.join(merged, both.root == merged.node, "left").select(*ROW, F.coalesce(merged.root, both.root).alias("root"))
    return keep_first(docs, rooted)
