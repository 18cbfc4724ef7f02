"""A corpus is built of raw records without a sort of records or vectors, and keeps one row of each hash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assay.sources import records as RC


def rows_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return RC.checked(RC.text_records(docs).withColumn("split", F.lit("train"))).select("sha256", "label", "timestamp", "split", "value")


def sizes_in_task(spark, before):
    """Peak execution memory of the stages since `before`, for each of their tasks."""
    store = spark._jsc.sc().statusStore()
    got = store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in range(2, 6)])
    own = [got.apply(i) for i in range(got.size())]
    return {x.stageId(): x.peakExecutionMemory() / max(1, x.numTasks()) for x in own if x.stageId() > before}


def test_records_and_vectors_stay_out_of_sorts(spark, tmp_path):
    texts = [f"{i} " + "word" * (i % 5) + " A Bc d\n" * 3 for i in range(4000)] * 2 + [None, "", ""]
    rows = RC.staged(rows_of(spark, texts), "rows")
    before = max(sizes_in_task(spark, -1), default=-1)
    got = RC.build(rows, f"file://{tmp_path}/c").collect()
    assert sum(r.n for r in got) == 4001
    assert max(sizes_in_task(spark, before).values()) < 72 << 20  # two aggregations of hashes begin with 34 MB each
    back = spark.read.parquet(f"file://{tmp_path}/c/rows")
    assert back.select("sha256").distinct().count() == back.count() == 4001
    assert sorted(back.columns) == ["label", "sha256", "split", "timestamp", "x"] and back.where("size(x) = 2381").count() == 4001


def test_build_still_refuses(spark, tmp_path):
    rows = rows_of(spark, ["a", "b"])
    with pytest.raises(ValueError, match="more than one split"):
        RC.build(rows.unionByName(rows.withColumn("split", F.lit("test"))), f"file://{tmp_path}/c")
    with pytest.raises(ValueError, match="differ in their features"):
        RC.build(rows.unionByName(rows.withColumn("value", F.regexp_replace("value", '"paths":0', '"paths":9'))), f"file://{tmp_path}/c")


def test_vectors_keep_each_row(spark):
    r = rows_of(spark, ["a", "a", None, "b c"]).withColumn("more", F.lit(None).cast("string"))
    got = RC.vectorised(r)
    assert got.columns == ["sha256", "label", "timestamp", "split", "more", "x"] and got.count() == 4
