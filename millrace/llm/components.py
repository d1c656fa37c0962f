"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to ``(node long, root long)``; ``root`` is the smallest node of the component.

    Each round takes the smallest label among neighbours (a sum with map-side combine) and then the label of that
    label (pointer jumping), so that long chains halve; each round is written to the shared folder. Nodes without
    an edge don't appear. Null ends and loops are ignored. Raises if ``max_rounds`` don't suffice (2**60 long chains).
    """
    kept = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(max_rounds):
        sent = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "root")
        least = labels.select("node", "root").unionByName(sent).groupBy("node").agg(F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("upper"))
        old = labels.select("node", F.col("root").alias("old"))
        new = (
            least.join(old, "node")
            .join(up, F.col("root") == F.col("at"), "left")
            .select("node", F.least("root", "upper").alias("root"), "old")
        )
        new = written(new, "labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError(f"components not stable after {max_rounds} rounds")
