"""Trees of a node table numbered by intervals: what a task does with one tree.

Each node gets its place in depth-first order and the last place below it, so that a subtree is a range of places: sums over
subtrees come up level by level in arrays, and whatever a path gathers comes down so. A tree is a task's unit of work; ensembles
are spread by tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Numbered:
    """A tree's reachable nodes in depth-first order: parents before children, left before right.

    `rows` gives their places in the table; left, right and parent are places in this order, or -1."""

    def __init__(self, node: np.ndarray, left: np.ndarray, right: np.ndarray):
        by_id = np.argsort(node, kind="stable")
        ids = node[by_id]
        if (ids[1:] == ids[:-1]).any():
            raise ValueError("a node stands twice in its tree")

        def places(kids: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(ids, kids), len(ids) - 1)
            if (ids[at] != kids).any():
                raise ValueError("a child is missing from its tree")
            return by_id[at]

        n = len(node)
        parent, depth, size, first = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64), np.zeros(n, np.int64)
        kids = np.full((2, n), -1)
        level, levels, d = np.flatnonzero(node == 0), [], 0
        while len(level):
            if (depth[level] >= 0).any() or len(np.unique(level)) < len(level):
                raise ValueError("a node is reached twice")
            depth[level] = d
            levels.append(level)
            inner = level[left[level] >= 0]
            kids[:, inner] = places(left[inner]), places(right[inner])
            parent[kids[:, inner]] = inner
            level, d = kids[:, inner].ravel(), d + 1
        inners = [x[left[x] >= 0] for x in levels]
        for inner in reversed(inners):
            size[inner] += size[kids[:, inner]].sum(0)
        for inner in inners:
            first[kids[0, inner]] = first[inner] + 1
            first[kids[1, inner]] = first[inner] + 1 + size[kids[0, inner]]
        reached = np.flatnonzero(depth >= 0)
        self.rows = reached[np.argsort(first[reached])]
        new = lambda x: np.where(x[self.rows] >= 0, first[x[self.rows]], -1)
        self.left, self.right, self.parent = new(kids[0]), new(kids[1]), new(parent)
        self.depth, self.last = depth[self.rows], np.arange(len(self.rows)) + size[self.rows] - 1
        self.is_left = np.zeros(len(self.rows), bool)
        self.is_left[self.left[self.left >= 0]] = True
        self.levels = [np.flatnonzero(self.depth == k) for k in range(len(levels))]

    def below(self, leaf_values: np.ndarray) -> np.ndarray:
        """Of each node the sum over its leaves, level by level from below: differences of a running sum would carry the rounding of
        the whole tree into each node."""
        out = np.where(self.left < 0, leaf_values, 0.0).astype(float)
        for level in reversed(self.levels):
            inner = level[self.left[level] >= 0]
            out[inner] = out[self.left[inner]] + out[self.right[inner]]
        return out

    def down(self, start: float, step: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type = float) -> np.ndarray:
        """Values from the root down: step(nodes of a level, the values of their parents)."""
        out = np.full(len(self.rows), start, kind)
        for level in self.levels[1:]:
            out[level] = step(level, out[self.parent[level]])
        return out

    def paths(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of edges, the nodes below each edge from the root on, one leaf's after another's)."""
        depth = self.depth[leaves]
        ends = np.cumsum(depth)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        at = leaves.copy()
        for k in range(1, int(depth.max(initial=0)) + 1):  # the last edge first
            live = np.flatnonzero(depth >= k)
            out[ends[live] - k] = at[live]
            at[live] = self.parent[at[live]]
        return depth, out


def by_tree(nodes: DataFrame, work: Callable[[pa.Table, Numbered], pa.Table | None], schema: str) -> DataFrame:
    """work on each tree of a node table (tree, node, left, right, ...)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables))
        got = work(table, Numbered(*(table.column(c).to_numpy().astype(np.int64) for c in ("node", "left", "right"))))
        if got is not None:
            yield from got.to_batches()

    return nodes.groupBy("tree").applyInArrow(run, schema)


def lists_of(sizes: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    """A list of structs for each of `sizes`."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
