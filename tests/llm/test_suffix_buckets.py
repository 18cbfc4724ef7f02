"""Buckets of anchors get equal shares: the hash of an anchor is the least of some, so ranges of bare hashes would not."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from assay.llm import suffixes as S
from assay.llm.lm import _cuts


def _texts(n: int) -> S.Texts:
    rng = random.Random(3)
    text = ["".join(rng.choices("abcdefghij klmnop", k=2000)) for _ in range(n)]
    return S.Texts(pa.table({"text": text, "rank": pa.array(range(n), pa.int64())}))


def test_anchor_lists_are_of_equal_size():
    sizes = np.array([len(body) for _, body in S._anchor_keys(_texts(200), 20)])
    assert len(sizes) == 20 and sizes.max() < 1.3 * sizes.mean()


def test_entries_are_dealt_evenly_and_in_order():
    texts = _texts(100)
    key = np.unique(np.concatenate([run.anchors()[1] for run in texts.runs()]))
    rows, _, _ = S.block_entries(texts, key, 40)
    bucket = np.ascontiguousarray(rows[:, : S.HEAD]).view(">u4").ravel().astype(np.int64)
    counts = np.bincount(bucket, minlength=40)
    assert (np.diff(bucket) >= 0).all() and counts.max() < 1.5 * counts.mean() and np.diff(_cuts(key, 40)).max() < 1.5 * len(key) / 40
