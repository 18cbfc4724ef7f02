"""Recall of the tables where real differences lie in the coded axes."""

from __future__ import annotations

import numpy as np
import pytest

from assay.llm import neardup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(sample, threshold=0.93, nodes=2**17, seed=3):
    """Share of pairs at the threshold, apart by noise in the first 128 axes, that meet in a table."""
    rng = np.random.default_rng(seed)
    x = sample[:2000]
    aside = np.zeros_like(x)
    aside[:, :128] = rng.normal(size=(len(x), 128))
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    model = neardup.fit_model(sample, nodes, threshold)
    a, b = (neardup.substrings(v, model) for v in (x, threshold * x + np.sqrt(1 - threshold**2) * aside))
    return (a == b).any(0).mean(), model


@pytest.mark.parametrize("pairs", [False, True])
def test_recall_of_wide_vectors(pairs):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(3000, 128)), 0.2 * rng.normal(size=(3000, 640))], 1)
    if pairs:  # the sample holds near-duplicates itself
        x[2000:] = x[:1000] + 0.38 * np.concatenate([rng.normal(size=(1000, 128)), np.zeros((1000, 640))], 1)
    got, model = recall(unit(x))
    print(f"recall {got:.4f}, {model['tables']} tables of {model['bits']} bits")
    assert got >= 0.98
