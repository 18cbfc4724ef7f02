"""Rendered vectors with and without what all records have alike, whole and summed up in their tasks."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.catalog import rendered as RR
from assay.features import raw, rendering
from assay.features.hashing import HashedBlocks, murmur3_many
from assay.loaders import trees as L
from assay.sources import records as RC
from tests.conftest import SF


@pytest.mark.parametrize("vocabulary", [None, RR.VOCABULARY])
def test_summaries_are_those_of_whole_vectors(spark, vocabulary):
    own = RR.latents(spark, SF).where("id < 400")
    first, width, shift, at = (RR._AT["section"] + 5, 150, 5, RR._AT) if vocabulary is None else (RR._AT3["imports"] + 2, 1280, 0, RR._AT3)
    x = {r.id: np.array(r.x) for r in rendering.render(own, vocabulary=vocabulary).collect()}
    got = {r.id: r for r in rendering.render(own, vocabulary=vocabulary, **RR._part(first, width, shift, at)).collect()}
    assert x.keys() == got.keys() and len(x) > 50
    for k, v in x.items():
        part = v[first : first + width]
        assert (got[k].n_sections, got[k].size, got[k].mass, got[k].checksum) == (v[at["section"]], v[at["general"]], np.abs(part).sum(), sum(p * ((i + shift) % 97 + 1) for i, p in enumerate(part)))
    value = own.select(rendering.record(F.lit(".s1")).alias("v")).first().v
    assert len(value) < 3000 and raw.problem({**rendering.UNSAID, **json.loads(value)}) is None and not rendering.UNSAID.keys() & json.loads(value).keys()


def test_lists_that_rows_share_count_for_each():
    shared, other = [1] * 4, [0, 2, 2, 0]
    got = raw.normalised([shared, other, shared, None, [1]], 4, -1.0)
    assert got.tolist() == [[0.25] * 4, [0, 0.5, 0.5, 0], [0.25] * 4, [-1] * 4, [-1] * 4]


def test_cells_add_up():
    out, blocks = np.ones((3, 40)), HashedBlocks()
    blocks.add(0, 0, 10, ["a", "b", "a"])
    blocks.add(2, 20, 20, ["a", "c"], [2.0, 0.5], signed=False)
    blocks.pour(out)
    want = np.ones((3, 40))
    for row, at, width, t, w, signed in [(0, 0, 10, "a", 1, True), (0, 0, 10, "b", 1, True), (0, 0, 10, "a", 1, True), (2, 20, 20, "a", 2, False), (2, 20, 20, "c", 0.5, False)]:
        h = int(murmur3_many([t.encode()])[0])
        want[row, at + abs(h) % width] += w if h >= 0 or not signed else -w
    assert (out == want).all()


def test_ratios_of_records(spark):
    docs = spark.createDataFrame([(1, "one\ntwo")], "doc_id bigint, text string")
    plain, more = (json.loads(RC.text_records(docs, ratio=r).first().value) for r in (None, 0.5))
    assert all(s.pop("size_ratio") == s.pop("vsize_ratio") == 0.5 for s in more["section"]["sections"]) and more == plain


def test_rows_are_scored_together(spark):
    """Attributions of many rows: few calls of the model, each row's as by itself."""
    rng, sizes = np.random.default_rng(2), []
    x, background = rng.normal(size=(40, 5)), rng.normal(size=(3, 5))

    def predict(m):
        return m[:, 0] * m[:, 1] + np.sin(m[:, 2]) - m[:, 3] ** 2 * m[:, 4]

    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {r.id: r.shap for r in L.permutation_shap(rows.coalesce(1), background, predict, "id", "v", 2).collect()}
    walks = [w for g in [np.random.default_rng(0)] for _ in range(2) for p in [g.permutation(5)] for w in (p, p[::-1])]
    for i, row in enumerate(x):
        want = np.zeros(5)
        for walk in walks:
            steps = background.copy()
            for f in walk:
                before = predict(steps).mean()
                steps[:, f] = row[f]
                want[f] += (predict(steps).mean() - before) / len(walks)
        assert np.allclose(got[i], want, atol=1e-12)
