"""Connected components of a graph of links, as a sequence of contractions.

Each round hooks every node to its least neighbour (or itself), follows the hooks
by doubling until they end (a chain of length L takes log L steps), and carries
the links over to the ends, until no link between different nodes is left.  The
least node of a component is never hooked to another, so it is what all end at.
Least neighbours are found by partial aggregation, so a node with very many links
costs no task more than its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import Scratch, few


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): label is the least node that can be reached."""
    keep, drop = scratch.keep, scratch.drop
    links = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links-0")
    labels, n = None, 0
    while n == 0 or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = _ends(keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-hooks-{n}"), scratch, f"{name}-ends-{n}")
        if labels is None:
            labels = ends
        else:
            onward = few(ends.select(F.col("node").alias("label"), F.col("label").alias("to")))
            labels = keep(labels.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels-{n}")
        over = links.join(few(ends.select(F.col("node").alias("a"), F.col("label").alias("la"))), "a").join(few(ends.select(F.col("node").alias("b"), F.col("label").alias("lb"))), "b")
        over = over.where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct()
        n += 1
        links = keep(over, f"{name}-links-{n}")
        drop(f"{name}-links-{n - 1}", f"{name}-hooks-{n - 1}")
    drop(f"{name}-links-{n}")
    return labels


def _ends(hooks: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): where each node's hooks lead to."""
    k = 0
    while True:
        onward = few(hooks.select(F.col("node").alias("label"), F.col("label").alias("to")))
        jumped = scratch.keep(hooks.join(onward, "label").select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")), f"{name}-{k}")
        hooks = jumped.select("node", "label")
        scratch.drop(f"{name}-{k - 1}")
        if jumped.where("moved").isEmpty():
            return hooks
        k += 1
