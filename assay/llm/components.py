"""Connected components of a link table, by contraction.

Each round hooks every vertex to its smallest neighbour, follows the hooks to their roots by
doubling, and replaces edges by edges between roots; loops and repeats go. All tables are written
to the shared folder between rounds, so nothing is collected and a lost executor costs no round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) long to (node, root): for each node that has an edge, the smallest node reachable.

    Repeated edges, loops and both directions are allowed; an edge with a null end is left out.
    """
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = staged(live, "cc-edges")
    whole = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        hooks = staged(hooks, "cc-hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            doubled = staged(hooks.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "cc-hooks")
            moved = not doubled.where("moved").isEmpty()
            hooks = doubled.drop("moved")
            if not moved:
                break
        if whole is None:
            whole = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            whole = staged(whole.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-whole")
        roots_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        roots_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        next_ = live.join(roots_a, "a").join(roots_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live = staged(next_, "cc-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if whole is None else whole


def stars(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row that it is connected to."""
    n = len(linked)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == root).all():
            return root
        root = new
