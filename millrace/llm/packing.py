"""Best-fit packing under conflicts.

Bins of a shard stand in the order of their residual capacity and carry a bitmap of sources and one of duplicate clusters;
a successor search goes from the tightest bin that fits to roomier ones until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, with_row, word_count, written
from millrace.llm.near_copies import near_copies

#: Bits of a bin's bitmaps. Ids share bits by hash, which may only keep two items apart that could lie together.
SOURCE_BITS, CLUSTER_BITS = 256, 1024


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and start of each item, in best-fit order of falling size (ties: as given).

    ``sources`` and ``clusters`` are bit numbers, -1 for none. Two items of a source bit or a cluster bit never share a bin.
    """
    # ordered by residual; the number of the bin breaks ties, so that the oldest of equal bins comes first
    line: list[tuple[int, int]] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    left: list[int] = []
    placed: list[tuple[int, int]] = []
    # for items alike in size and bits: up to where bins are known to conflict, how far ``placed`` was read, and what was found in it meanwhile
    known: dict[tuple[int, int, int], tuple[tuple[int, int], int, list[tuple[int, int]]]] = {}
    bins, starts = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size, alike = sizes[i], (sizes[i], sources[i], clusters[i])
        s = 1 << sources[i] if sources[i] >= 0 else 0
        c = 1 << clusters[i] if clusters[i] >= 0 else 0
        fits = lambda x: left[x[1]] == x[0] and not (source_map[x[1]] & s or cluster_map[x[1]] & c)  # noqa: B023, E731
        upto, read, fresh = known.get(alike, ((size, -1), len(placed), []))
        fresh = [x for x in [*fresh, *placed[read:]] if size <= x[0] and x < upto and fits(x)]
        at = bisect_left(line, upto)
        while at < len(line) and not fits(line[at]):
            at += 1
        found = line[at] if at < len(line) else (capacity + 1, 0)
        known[alike] = (found, len(placed), fresh)
        best = min([found, *fresh])
        if best[0] <= capacity:
            b = best[1]
            line.pop(bisect_left(line, best))
        else:
            b = len(left)
            left.append(capacity)
            source_map.append(0)
            cluster_map.append(0)
        bins[i], starts[i] = b, capacity - left[b]
        source_map[b] |= s
        cluster_map[b] |= c
        left[b] -= size
        if left[b]:
            insort(line, (left[b], b))
            placed.append((left[b], b))
    return bins, starts


def pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = 4000) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` to pieces ``(doc_id, piece, first_word, n_words, bin_id, start)``.

    Every word of every document lies in exactly one piece. A document over ``capacity`` words is cut into full pieces, each
    a bin of its own, and a rest; documents without words (null, empty) are one piece of 0 words. A bin holds at
    most ``capacity`` words, at most one piece of a source (null sources don't conflict) and at most one of a duplicate
    cluster (a component of near copies: five-word shingles, similarity 0.8 or more). Rows are dealt by hash into shards of about ``shard_rows``, packed on their own; a bin is
    ``shard-number``. Repeated rows are packed each for itself. Empty table: empty result. Other columns are ignored.
    """
    roots = written(near_copies(docs).distinct(), "packing-clusters")
    source = F.when(F.col("source").isNull(), -1).otherwise(F.pmod(F.xxhash64("source"), F.lit(SOURCE_BITS))).cast("int")
    rows = with_row(docs).select("doc_id", *ROW, word_count(F.col("text")).alias("size"), source.alias("source_bit"))
    item = rows.join(roots, list(ROW)).select("doc_id", "th", "size", "source_bit", F.xxhash64("root").alias("cluster"))
    shards = max(1, -(-docs.select(F.lit(1)).count() // shard_rows))
    spread = item.select(
        "doc_id", "size", "source_bit",
        F.pmod(F.col("cluster"), F.lit(CLUSTER_BITS)).cast("int").alias("cluster_bit"),
        F.pmod(F.xxhash64("doc_id", "th"), F.lit(shards)).cast("int").alias("shard"),
    )

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("bin_id", pa.string()), ("start", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        rows = zip(*(group.column(c).to_pylist() for c in ("doc_id", "size", "cluster_bit", "source_bit")))
        own = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
        parts = [(i, *divmod(r[1], capacity)) for i, r in enumerate(own)]
        rest = [(i, full, left) for i, full, left in parts if left or not full]
        bins, starts = best_fit([left for _, _, left in rest], [own[i][3] for i, _, _ in rest], [own[i][2] for i, _, _ in rest], capacity)
        out = [(own[i][0], full, full * capacity, left, b, at) for (i, full, left), b, at in zip(rest, bins, starts)]
        next_bin = count(max(bins, default=-1) + 1)
        out += [(own[i][0], k, k * capacity, capacity, next(next_bin), 0) for i, full, _ in parts for k in range(full)]
        shard = group.column("shard")[0].as_py()
        return pa.Table.from_pylist([dict(zip(schema.names, (d, p, f, n, f"{shard}-{b}", at))) for d, p, f, n, b, at in out], schema=schema)

    return spread.groupBy("shard").applyInArrow(run, "doc_id long, piece long, first_word long, n_words long, bin_id string, start long")
