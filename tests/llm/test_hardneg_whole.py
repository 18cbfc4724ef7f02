"""Anchors that walk a vantage-point tree together get what brute force gives them, with work in numpy and not in a queue an anchor."""

from __future__ import annotations

import time

import numpy as np
import pytest

from assay.llm.hardneg import NONE, Places, VantageTree


def brute(rows, ids, anchors, ok, k, anchor, low, high):
    out = []
    for a, lo, hi in zip(anchor.tolist(), low.tolist(), high.tolist(), strict=True):
        own = [(-sum(x * y for x, y in zip(anchors[a].tolist(), r.tolist(), strict=True)), int(i)) for r, i, good in zip(rows, ids, ok[a], strict=True) if good]
        out.append(sorted(x for x in own if lo <= -x[0] <= hi)[:k])
    return out


@pytest.mark.parametrize("scale", [40, 10**9 // 2])
def test_walk_of_many_anchors(scale):
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(12, 1, 5)) * 3 + rng.normal(size=(12, 25, 5)) * rng.choice([0.01, 1.0], size=(12, 25, 1))).reshape(-1, 5)
    rows = np.concatenate([rows, rows[:20], rows[:20]])  # ties
    rows = (rows * scale / np.abs(rows).max()).round().astype(np.int64)
    ids = rng.permutation(len(rows))
    anchors = rows[::9]
    ok = rng.random((len(anchors), len(rows))) < 0.6
    most = float((rows.astype(float) ** 2).sum(1).max())
    n = len(anchors) * 2
    anchor = np.repeat(np.arange(len(anchors)), 2)
    high = np.array([(1 << 62) if i % 2 == 0 else int(rows[i] @ anchors[i // 2]) for i in range(n)])
    low = np.where(high == 1 << 62, NONE + 1, high * 8 // 10)
    places = Places(5, anchor, low, high, np.float64 if most < 2**53 else np.int64)
    for part in (np.arange(0, len(rows), 2), np.arange(1, len(rows), 2)):  # two shards
        tree = VantageTree(rows[part], most, 16)
        for a in range(0, n, 7):
            tree.fill(places, np.arange(a, min(a + 7, n)), anchors, lambda x, r, part=part: ok[x][:, part[r]], ids[part])
    got = [[(-int(s), int(i)) for s, i in zip(*x, strict=True) if s > NONE] for x in zip(places.scores, places.ids, strict=True)]
    assert got == brute(rows, ids, anchors, ok, 5, anchor, low, high)


def test_many_anchors_take_no_queue_each():
    """A shard of 4,096 rows in 64 dimensions, where annuli close little: 1,000 anchors took 14 CPU seconds in queues of their own."""
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(4096, 64)) * 256).round().astype(np.int64)
    most = float((rows**2).sum(1).max())
    places = Places(5, np.arange(1000), np.full(1000, NONE + 1), np.full(1000, 1 << 62), np.float64)
    began = time.process_time()
    tree = VantageTree(rows, most)
    tree.fill(places, np.arange(1000), rows[:1000], lambda a, r: r != a[:, None], np.arange(4096))
    assert time.process_time() - began < 5
    score = rows[:1000] @ rows.T
    score[np.arange(1000), np.arange(1000)] = NONE
    assert (places.scores == -np.sort(-score, axis=1)[:, :5]).all()
