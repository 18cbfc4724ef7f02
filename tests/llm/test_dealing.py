"""Operators that scan twice don't depend on how a scan is dealt the second time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assay.llm.bpe import encode
from assay.llm.lm import lm_scores
from assay.llm.queries import tokenizer_path
from assay.llm.suffixes import remove_repeats

MAKERS = {
    "bpe": lambda docs: encode(docs, tokenizer_path()).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids")),
    "lm": lambda docs: lm_scores(docs, F.col("doc_id") % 7 != 2, F.col("doc_id") % 7 == 3).select("doc_id", "n_tokens", F.round("score", 6).alias("score")),
    "suffixes": lambda docs: remove_repeats(docs).select("doc_id", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept")),
}


@pytest.mark.parametrize("name", MAKERS)
def test_other_parallelism_between_building_and_running(spark, tmp_path, name):
    rng = random.Random(1)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(30))
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(40)) + (passage if i % 5 == 0 else "")) for i in range(240)]
    for k in range(6):
        spark.createDataFrame(docs[k::6], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    key, got, counts = "spark.sql.leafNodeDefaultParallelism", [], []
    try:
        for build, run in ((3, 3), (3, 6), (6, 1)):
            spark.conf.set(key, build)
            read = spark.read.parquet(str(tmp_path / "docs"))
            out = MAKERS[name](read)
            spark.conf.set(key, run)
            counts.append((read.rdd.getNumPartitions()))
            got.append(sorted(tuple(r) for r in out.collect()))
    finally:
        spark.conf.unset(key)
    assert len(set(counts)) > 1  # the scan itself is dealt otherwise
    assert got[0] == got[1] == got[2] and len(got[0]) == 240
