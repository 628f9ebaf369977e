"""Connected components of an edge table, by contraction.

Every round each label hooks onto the smallest neighbouring label; the hooks form trees, whose roots
are found by pointer doubling; the edges are then rewritten to roots, and those inside one tree go.
Each round leaves at most half the labels that still have neighbours. Every intermediate result is
written to the shared folder; the driver sees only whether anything is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import join_measured, stored


def _roots(hooks: DataFrame) -> DataFrame:
    """hooks (at, to), ``to`` < ``at``: follow each chain to its end."""
    while True:
        step = hooks.select(F.col("at").alias("_via"), F.col("to").alias("_end"))
        longer = stored(join_measured(hooks, step, [("to", "_via")]), "roots")
        if longer.where(F.col("_end").isNotNull()).isEmpty():
            return hooks
        hooks = longer.select("at", F.coalesce("_end", "to").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node with an edge; ``root`` is the smallest node reachable."""
    edges = stored(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        hooks = stored(edges.groupBy(F.col("b").alias("at")).agg(F.min("a").alias("to")), "hooks")
        roots = _roots(hooks)
        if labels is None:
            ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
            labels = ends.select("node", F.col("node").alias("root"))
        moved = join_measured(labels, roots, [("root", "at")])
        labels = stored(moved.select("node", F.coalesce("to", "root").alias("root")), "labels")
        a = roots.select(F.col("at").alias("_a"), F.col("to").alias("_ra"))
        b = roots.select(F.col("at").alias("_b"), F.col("to").alias("_rb"))
        both = join_measured(join_measured(edges, a, [("a", "_a")]), b, [("b", "_b")])
        both = both.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")).where(F.col("a") != F.col("b"))
        edges = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
