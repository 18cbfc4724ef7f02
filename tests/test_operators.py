"""Worked values and edge cases of the evaluation operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assay.functions import bytes as B
from assay.functions import scalars as S
from assay.operators import metrics as M
from assay.operators import selection as sel
from assay.operators import windows as W
from assay.sources import corpora as C
from tests.conftest import SF


def rows(spark, pairs):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(pairs)], "row_id bigint, label int, score double")


def test_wilson_worked_values(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (0, 0), (10, 10)], "k bigint, n bigint")
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(F.round(lo, 5), F.round(hi, 5)).collect()]
    assert got == [(0.0, 0.27753), (0.23659, 0.76341), (None, None), (0.72247, 1.0)]


def test_threshold_at_zero_false_positives(spark):
    got = M.threshold_for_fpr(rows(spark, [(0, 0.1), (0, 0.6), (1, 0.6), (1, 0.9)]), 0.0).first()
    assert (got.threshold, got.tpr) == (0.9, 0.5)


def test_threshold_null_when_only_the_empty_point_fits(spark):
    assert M.threshold_for_fpr(rows(spark, [(1, 0.1), (0, 0.9)]), 0.0).first().threshold is None


def test_auroc_ties_and_missing_class(spark):
    assert M.auroc(rows(spark, [(0, 0.5), (1, 0.5)])).first().auroc == 0.5
    assert M.auroc(rows(spark, [(1, 0.5), (1, 0.7)])).first().auroc is None


def test_confusion_zero_division(spark):
    got = M.confusion(rows(spark, [(1, 0.1)]), 0.5).first()
    assert (got.precision, got.recall, got.f1, got.fpr) == (0.0, 0.0, 0.0, None)


def test_area_under_time_worked_values(spark):
    df = spark.createDataFrame([(1, 0.9, 1000), (2, 0.8, 100), (3, 0.5, 1000)], "k int, f1 double, tp int").withColumns({c: F.lit(0) for c in ("fp", "fn", "tn")})
    got = W.area_under_time(df).first()
    assert got.aut == pytest.approx(0.75) and got.aut_weighted == pytest.approx(1560 / 2200)
    assert W.area_under_time(df.where("k = 1")).first().aut is None


def test_metric_score_anchors(spark):
    df = spark.createDataFrame([(0.5,), (0.9,), (0.2,), (None,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(S.metric_score(F.col("v"), ">=", 0.5, 0.9, 0.2)).collect()]
    assert got == [0.75, 1.0, 0.0, None, None]
    assert df.limit(1).select(S.metric_score(F.col("v"), ">", 0.5, 0.9, 0.2)).first()[0] < 0.75


def test_murmur3_published_values():
    assert B.murmur3_32(b"") == 0
    assert B.murmur3_32(b"", 1) == 0x514E28B7
    assert B.murmur3_32(b"hello", 0) == 0x248BFA47
    assert B.murmur3_32(b"kernel32.dll:x", 42) == -883661802


def test_empty_include_selects_nothing_and_empty_exclude_all(spark):
    ev = C.events_corpus(spark, SF)
    none = ev.select("sha256").limit(0)
    assert sel.select_rows(ev, include=none).count() == 0
    assert sel.select_rows(ev, exclude=none, labeled_only=False).count() == ev.count()


def test_manifest_lines(spark):
    a, b = "a" * 64, "B" * 64
    lines = spark.createDataFrame([("﻿sha256,size",), (f"{a},1",), (f" {b} ",), ("# note",), ("",), (a,)], "value string")
    assert sorted(r.sha256 for r in C.manifest_hashes(lines).collect()) == [a, b.lower()]
    with pytest.raises(Exception, match="not a SHA-256"):
        C.manifest_hashes(spark.createDataFrame([("zz",)], "value string")).collect()


def test_corpus_round_trip_and_refusal(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    C.write_corpus(C.events_corpus(spark, SF), path, "events", "1")
    assert C.load_corpus(spark, path).count() == C.events_corpus(spark, SF).count()
    C.events_corpus(spark, SF).limit(3).write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="differs"):
        C.load_corpus(spark, path)


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan


def test_streaming_windows_equal_batch(spark, tmp_path):
    from assay.streaming import windows as SW

    src = C.events_corpus(spark, SF).where("timestamp is not null").select(F.col("timestamp").cast("timestamp").alias("ts"), "label", "score")
    src.write.parquet(f"{tmp_path}/in")
    stream = SW.scored_stream(spark, f"{tmp_path}/in", src.schema)
    q = SW.start(SW.window_counts(stream, 0.5), "drift_counts", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {r.start: (r.tp, r.fp, r.fn, r.tn) for r in spark.sql("SELECT * FROM drift_counts").collect()}
    want = M.confusion(src.withColumn("start", F.window("ts", "7 days").start), 0.5, "start").collect()
    assert got == {r.start: (r.tp, r.fp, r.fn, r.tn) for r in want}
