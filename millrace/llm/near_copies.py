"""Near copies of texts by a set-similarity join of their five-word shingles.

A set is described by its size and its 64 shingles of the smallest hashes, a random sample of it. Shingles are ordered by their count over all
samples, and a set meets others by the rarest of its sample: so many that, by the prefix principle, two samples with the overlap that similar sets have
share one. Candidates whose lengths, 512-bit parities and samples admit a similarity of 0.8 are verified on the whole sets. Members of crowds are
joined to the likest of a few leaders first, so that only texts of different components are compared after that.

Sets of up to 51 shingles, whose partners are also held whole, have the exact overlap. Others count on 30 common shingles in their samples; a pair
at a similarity of 0.8 has fewer with a chance of 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import ROW, TEXTS, keep_first, with_row, written
from millrace.llm.components import connected_components

#: Similar: a Jaccard similarity of NUM / DEN or more.
NUM, DEN, WIDTH = 4, 5, 5
#: Shingles of a sample; those that two samples have in common at least; sizes up to which a set and its partners are held whole.
SAMPLE, OVERLAP, WHOLE = 64, 30, 51
#: Bits of the parity of a set; two parities differ in no more bits than the sets do in shingles.
PARITY = 512
#: Sets of a shingle, in the order of a hash, that the others of this shingle are held against in one round.
LEADERS = 16
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, the runs of bytes other than ASCII white space: differences of one running sum over all bytes."""
    out = []
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        b = np.frombuffer(text, dtype=np.uint8, count=min(end, len(text)) - at, offset=at)
        at = end
        blank = np.ones(len(b) + 2, dtype=np.int8)
        blank[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
        turn = np.diff(blank)
        begins, ends = np.nonzero(turn == -1)[0], np.nonzero(turn == 1)[0]
        size = max(1 << 12, 1 << int(len(b)).bit_length())
        up, down = _powers(max(size, 1 << 18))
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b + np.uint64(1)) * up[: len(b)], out=total[1:])
        h = (total[ends] - total[begins]) * down[begins]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the lower-cased five-word shingles; fewer than five words are one shingle, none are none."""
    w = _word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))
    n = max(1, len(w) - WIDTH + 1) if len(w) else 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(WIDTH, len(w))):
        h = h * np.uint64(_BASE) + w[k : k + n]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = np.sort((h ^ (h >> np.uint64(29))) >> np.uint64(1))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _identity(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).view(np.int64))


def _parity(s: np.ndarray) -> np.ndarray:
    """Whether each class of shingles modulo ``PARITY`` has an odd number of them, in words of 64 bits."""
    odd = np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _described(rows: DataFrame) -> DataFrame:
    """``(no_id, did, th, cid, size, keys, parity)``: each row with the identity, the size, the sample and the parity of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(3).to_pylist()]
            own = ([_identity(s) for s in sets], [len(s) for s in sets], [s[:SAMPLE].view(np.int64) for s in sets], [_parity(s) for s in sets])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, own, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=[*ROW, "cid", "size", "keys", "parity"])

    return rows.mapInArrow(run, "no_id boolean, did long, th long, cid long, size int, keys array<long>, parity array<long>")


def _entries(sets: DataFrame) -> DataFrame:
    """``(key, n, cid, times)`` of the shared shingles in the prefix of each sample of ``sets(cid, size, keys)``, rarest first.

    Shingles of one sample alone come before all others and meet nothing, so that only the rest is put in order.
    """
    every = sets.where("size > 0").select("cid", F.col("size").alias("n"), F.size("keys").alias("have"), F.explode("keys").alias("key"))
    shared = every.withColumn("times", F.count("*").over(Window.partitionBy("key"))).where("times > 1")
    of_set = Window.partitionBy("cid")
    need = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * NUM / DEN)).otherwise(OVERLAP)
    placed = shared.withColumns({"place": F.row_number().over(of_set.orderBy("times", "key")), "alone": F.col("have") - F.count("*").over(of_set)})
    return placed.where(F.col("alone") + F.col("place") <= F.col("have") - need + 1).select("key", "n", "cid", "times")


def _may_match(n: Column, m: Column) -> Column:
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def _unlike(a: str, b: str) -> Column:
    """Bits by which two parities differ."""
    return reduce(add, [F.bit_count(F.get(f"{a}.parity", F.lit(i)).bitwiseXOR(F.get(f"{b}.parity", F.lit(i)))) for i in range(PARITY // 64)])


def _may_differ(n: Column, m: Column) -> Column:
    """Shingles that only one of two similar sets of these sizes has, at most."""
    return n + m - 2 * F.floor(((n + m) * NUM + NUM + DEN - 1) / (NUM + DEN))


def _alike(a: str, b: str) -> Column:
    """Whether two samples admit the similarity; exact for sets that they hold as a whole.

    Of the larger set's sample a share ``f`` is common, which the sizes give; 6.2 standard errors and 2.5 below it lie less than 1e-9 of all cases.
    """
    n, m, both = F.col(f"{a}.n"), F.col(f"{b}.n"), F.size(F.array_intersect(f"{a}.sample", f"{b}.sample"))
    f = (n + m) * NUM / (F.greatest(n, m) * (NUM + DEN))
    least = SAMPLE * f - 6.2 * F.sqrt(F.abs(SAMPLE * f * (1 - f))) - 2.5
    return F.when(F.greatest(n, m) <= SAMPLE, both * (NUM + DEN) >= (n + m) * NUM).when(F.least(n, m) <= SAMPLE, both >= OVERLAP).otherwise(both >= least)


def _similar(rows: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the written distinct ``pairs(a, b)`` whose whole sets are similar."""
    needed = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    places = written(firsts.join(needed, "cid"), "near-places")
    small = places.count() <= 1_000_000
    # texts, which compress, are moved rather than their sets
    texts = rows.join(F.broadcast(places) if small else places, list(ROW)).groupBy("cid").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def whole(cid: int, text: str) -> np.ndarray:
            if cid not in held:
                if sum(map(len, held.values())) > 1 << 22 or len(held) >= 512:
                    held.clear()
                held[cid] = shingles(text)
            return held[cid]

        for batch in batches:
            same = []
            for a, b, t, u in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = whole(b, u), whole(a, t)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same.append(int((y[at] == x).sum()) * (NUM + DEN) >= (len(x) + len(y)) * NUM)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    full = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """``(no_id, did, th, root)`` of every document of ``docs(doc_id, text, ...)``, see ``with_row``; equal roots are one component.

    Texts link at a Jaccard similarity of 0.8 or more of their lower-cased five-word shingles; equal sets, and texts without a word, are one.
    ``rounds`` of leaders only save comparisons: what they leave in different components is compared in full.
    """
    rows = with_row(docs.select("doc_id", "text")).select(*ROW, "text")
    both = written(_described(rows), "near-rows", TEXTS)
    of = both.select(*ROW, "cid")
    firsts = of.groupBy("cid").agg(F.min(F.struct(*ROW)).alias("o")).select("cid", "o.*")
    by_key = Window.partitionBy("key")
    sets = written(both.select("cid", "size", "keys", "parity").dropDuplicates(["cid"]), "near-sets")
    shared = written(_entries(sets), "near-shared")
    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    for k in range(rounds + 1):
        at = shared.join(roots, shared.cid == roots.node, "left").select("key", "n", "cid", "times", F.coalesce("root", "cid").alias("comp"))
        fits = (F.col("x.key") == F.col("y.key")) & _may_match(F.col("x.n"), F.col("y.n")) & (_unlike("x", "y") <= _may_differ(F.col("x.n"), F.col("y.n")))
        if k < rounds:
            # each set by one of its shingles, the commonest first and any in later rounds, against the leaders of that shingle
            by = F.xxhash64("key", F.lit(k)) if k else F.col("times")
            own = at.groupBy("cid").agg(F.max(F.struct(by.alias("by"), "key", "n", "comp")).alias("o")).select("cid", "o.key", "o.n", "o.comp")
            lead = at.withColumn("place", F.row_number().over(by_key.orderBy(F.xxhash64("cid", F.lit(k)), "cid"))).where(F.col("place") <= LEADERS).drop("place", "times")
            parities = sets.select("cid", "parity")
            x, y = own.join(parities, "cid").alias("x"), lead.join(parities, "cid").alias("y")
            near = x.join(y, (F.col("x.comp") != F.col("y.comp")) & fits).select(F.col("x.cid").alias("cid"), F.struct(_unlike("x", "y").alias("unlike"), F.col("y.cid").alias("to")).alias("lead"))
            pairs = near.groupBy("cid").agg(F.min("lead").alias("best")).select(F.least("cid", "best.to").alias("a"), F.greatest("cid", "best.to").alias("b")).distinct()
        else:
            # the largest component of a key is compared with the rest, not with itself
            sizes = written(at, "near-at").groupBy("key", "comp").agg(F.count("*").alias("size"))
            main = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("many")).where("many > 1").select("key", F.col("top.comp").alias("main"))
            at = written(at.join(main, "key"), "near-mixed")
            # samples by the upper halves of their keys, which take half the room; a pair meets at its first common shingle alone
            half = lambda k: F.shiftright(k, 32).cast("int")
            own = shared.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("times", "key")))["key"].alias("line"))
            halves = sets.select("cid", "parity", F.transform("keys", half).alias("sample")).join(own, "cid")
            at = at.join(halves, "cid").where("key is not null")
            x, y = at.where("comp <> main").alias("x"), at.alias("y")
            wanted = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid")))
            met = x.join(y, wanted & fits & (F.get(F.array_intersect("x.line", "y.line"), F.lit(0)) == F.col("x.key")) & _alike("x", "y"))
            pairs = met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
        pairs = written(pairs, "near-pairs")
        if pairs.isEmpty():
            continue
        edges = written(edges.unionByName(_similar(rows, firsts, pairs)), "near-edges", TEXTS)
        roots = connected_components(edges)
    return of.distinct().join(roots, of.cid == roots.node, "left").select(*ROW, F.coalesce("root", "cid").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies, see ``keep_first``."""
    return keep_first(docs, near_copies(docs))
