"""Pairs are made once, however often a fit reads them, and hashes of any spelling meet as the strings do."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import pairing as P
from assay.operators.ranks import hash_ranked
from assay.plans import modules as MO


def test_a_fit_pairs_the_corpus_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    corpus = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7 / 7.0).alias("score"))
    pairs = spark.range(1, 101).select(F.col("id").alias("pair"), (F.col("id") * 2).alias("member_row"), (F.col("id") * 2 + 1).alias("other_row"))
    pairs = pairs.mapInArrow(count, pairs.schema)
    got = MO.attack_scores(MO.pair_rows(corpus, pairs, 0.5, 3), "rf", 3).collect()
    assert len(got) == 100 and sum(r.label for r in got) == 50
    assert seen.value == 100


def test_hashes_of_any_spelling(spark):
    import hashlib

    h = hashlib.sha256(b"x").hexdigest()
    names = [h, h.upper(), h + "\n", h[:-1], "a", "", bytes.fromhex("61" * 32).decode(), "61" * 32, "61" * 31 + "6G", None]
    corpus = spark.createDataFrame([(i, x, 1, "test") for i, x in enumerate(names)], "row_id bigint, sha256 string, label int, split string").withColumn("timestamp", F.lit("2024-01-01").cast("date"))
    for x in names:
        manifest = spark.createDataFrame([(x,), (x,)], "sha256 string")
        got = {r.row_id: r.member for r in P.member_sides(corpus, manifest).collect()}
        assert [i for i in got if got[i]] == [i for i, y in enumerate(names) if y == x and x is not None], x


def test_ranks_follow_the_digits(spark):
    import hashlib

    got = {r.row_id: r["rank"] for r in hash_ranked(spark.range(3000).withColumnRenamed("id", "row_id"), [], 9).collect()}
    want = sorted(range(3000), key=lambda i: hashlib.sha256(f"9/{i}".encode()).hexdigest())
    assert [got[i] for i in want] == list(range(1, 3001))
