"""Sums over subtrees without the rounding of the rest of their tree."""

from __future__ import annotations

import numpy as np

from assay.operators.walk import Numbered


def test_a_small_subtree_beside_a_large_one():
    # 0: (1: (3, 4), 2: (5, 6)); a running sum over 1's leaves drowns the last digits of those below 2
    t = Numbered(np.arange(7), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]))
    leaf = np.array([0, 0, 0, 0.1, 1e9 / 3, 0.1, 0.2])
    got = dict(zip(t.rows.tolist(), t.below(leaf[t.rows]).tolist(), strict=True))
    assert got[2] == 0.1 + 0.2 and got[1] == 0.1 + 1e9 / 3 and got[0] == got[1] + got[2] and got[5] == 0.1


def test_equal_to_sums_over_leaves():
    n = 2**10 - 1
    left = np.where(np.arange(n) < n // 2, 2 * np.arange(n) + 1, -1)
    t = Numbered(np.arange(n), left, np.where(left >= 0, left + 1, -1))
    leaf = np.random.default_rng(1).integers(0, 1000, n).astype(float)
    leaves = np.where(t.left < 0, leaf[t.rows], 0.0)
    assert t.below(leaf[t.rows]).tolist() == [leaves[i : t.last[i] + 1].sum() for i in range(n)]
