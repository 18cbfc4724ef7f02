"""Ids that are named as an output column."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assay.llm import bpe, chosenpath, langid, linededup, lm, neardup, packing, pii, queries, search

TEXTS = [(i, f"some words of text number {i} and more of them", "en", 1) for i in range(6)]


def texts(spark, name):
    return spark.createDataFrame(TEXTS, f"`{name}` bigint, text string, lang string, other int")


CASES = {
    "n_tokens": lambda df, c: bpe.encode(df, queries.tokenizer_path(), c),
    "score": lambda df, c: langid.predict(df, *langid.train(df), id_col=c),
    "base_score": lambda df, c: lm.lm_scores(df, F.lit(True), F.lit(False), c),
    "n_links": lambda df, c: chosenpath.jaccard_join(df, id_col=c),
    "length": lambda df, c: packing.best_fit_packing(df, queries.tokenizer_path(), id_col=c),
    "kept": lambda df, c: linededup.line_dedup(df, c),
    "rank": lambda df, c: search.ranked_search(df, df.select(c, "text"), id_col=c, item_id_col=c),
    "pii": lambda df, c: pii.pseudonymise(df, "k", c),
}


@pytest.mark.parametrize("name", CASES)
def test_ids_keep_their_name(spark, tmp_path, name):
    out = CASES[name](texts(spark, name), name)
    assert name in out.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    out.write.parquet(str(tmp_path / "out"))
    assert {r[name] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(range(6))


def test_vectors_keep_their_name(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, [1.0, float(i)]) for i in range(6)], "kept bigint, label int, embedding array<float>")
    out = neardup.near_duplicates(rows, id_col="kept")
    assert out.columns == ["kept", "n_links", "component_id", "kept_"] and out.count() == 6
