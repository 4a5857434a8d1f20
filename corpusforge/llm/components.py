"""Connected components by hooking and shortcutting over parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.plans.stage import free, observed, staged


def _shortcut(parents: DataFrame) -> DataFrame:
    """Pointer jumping until each ``parent`` is a root; ``parents`` is a staged table and is used up."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        jumped = parents.join(up, parents.parent == F.col("_n"), "left").select("node", "parent", F.coalesce("_p", "parent").alias("_up"))
        table, seen = observed(jumped.select("node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved")), moved=F.count_if("moved"))
        free(parents)
        if not seen["moved"]:
            return table
        parents = table


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for each node of an edge: ``root`` is one of the nodes of the component.

    Each round hooks every node of the contracted graph to its smallest neighbour if that is smaller, shortcuts the
    parent table to its roots by pointer jumping, and replaces edges by edges between roots; a round at least halves
    the nodes that still have edges.  All is joins and pre-aggregated groups of staged tables, nothing is collected;
    what tells whether a loop ends is counted while its table is written.
    Null ends are dropped; loops keep their node as its own root; repeated edges count once; no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    live = staged(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        both = live.select(F.col("u").alias("node"), F.col("v").alias("other")).union(live.select(F.col("v").alias("node"), F.col("u").alias("other")))
        hooked = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent"))
        parents = _shortcut(staged(hooked))
        step = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        if labels is None:
            labels, spare = parents.select("node", F.col("parent").alias("root")), []
        else:
            grown = staged(labels.join(step, labels.root == F.col("_n"), "left").select("node", F.coalesce("_p", "root").alias("root")))
            free(labels)
            labels, spare = grown, [parents]
        pu, pv = (parents.select(F.col("node").alias(f"_n{x}"), F.col("parent").alias(f"_p{x}")) for x in "uv")
        moved = live.join(pu, F.col("u") == F.col("_nu")).join(pv, F.col("v") == F.col("_nv")).select("_pu", "_pv").filter("_pu != _pv")
        left, seen = observed(moved.select(F.least("_pu", "_pv").alias("u"), F.greatest("_pu", "_pv").alias("v")).distinct(), edges=F.count("*"))
        free(live, *spare)
        live = left
        if not seen["edges"]:
            return labels
