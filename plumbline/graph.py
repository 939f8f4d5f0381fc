"""Connected components of large graphs as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.staging import discard, stage

#: Edges of a node that one task is sent; a node with more of them is cut into cells.
CELL = 20_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100, rows: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours, then follows
    that label's own label, so that long chains shrink by halves. Every round is written
    to scratch, which cuts lineage and survives lost executors. A node's label goes to its
    edges in as many copies as it has cells of ``CELL`` edges, so that no hub fills a task.
    Edges with a null end are ignored; an empty table has no nodes. Raises where
    ``most_rounds`` rounds don't settle all labels. ``rows`` tells how many edges there are,
    about, where they may be too many for the session's partitions; later shuffles go by
    the distinct ones.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    once = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-pairs", grows=True, rows=rows)
    ends = 2 * once.count()
    both = once.union(once.select("b", "a"))
    state = stage(
        both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), F.ceil(F.col("n") / CELL).alias("cells")),
        "cc-labels",
        grows=True,
        rows=ends,
    )
    hubs = state.where("cells > 1").select(F.col("node").alias("hub"), F.col("cells").alias("of"))
    cut = F.pmod(F.xxhash64("a"), F.coalesce("of", F.lit(1))).alias("cell")
    dealt = stage(both.join(hubs, both["b"] == hubs["hub"], "left").select("a", "b", cut), "cc-edges", grows=True, rows=ends)
    start = [once, state]
    for _ in range(most_rounds):
        sent = state.select("node", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("at"))
        near = dealt.join(sent, (dealt["b"] == sent["node"]) & (dealt["cell"] == sent["at"])).groupBy("a").agg(F.min("label").alias("near"))
        lower = state.join(near, state["node"] == near["a"]).select("node", "cells", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = stage(lower, "cc-lower", grows=True, rows=ends)
        jump = lower.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = stage(lower.join(jump, lower["label"] == jump["via"]).select("node", "cells", "old", F.least("label", "far").alias("label")), "cc-jump", grows=True, rows=ends)
        discard(*start, lower)
        state, start = moved.select("node", "label", "cells"), [moved]
        if moved.where("label <> old").isEmpty():
            discard(dealt)
            return state.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
