"""Digests of corpora beyond what a long sum holds."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from assay.sources import corpora as C


def test_digest_of_many_rows(spark, tmp_path):
    """Row digests of 48 bits: some 65,000 of them are more than a long."""
    rows = spark.range(200_000).select(F.col("id").alias("row_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit("test").alias("split"))
    got = {tuple(C.content_hash(x, ["row_id", "sha256"]).first()) for x in (rows, rows.repartition(7, "sha256"))}
    assert len(got) == 1 and (one := next(iter(got)))[0] == 200_000 and 0 <= one[1] < 1 << 63
    assert C.content_hash(rows.where("row_id <> 7"), ["row_id", "sha256"]).first().digest_sum != one[1]
    path = f"file://{tmp_path}/c"
    C.write_corpus(rows, path, "many", "1")
    assert C.verify_corpus(spark, path).first().ok and C.load_corpus(spark, path, name="many").count() == 200_000


def test_digest_of_few_rows_is_their_sum(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "row_id bigint, sha256 string")
    import hashlib

    want = sum(int(hashlib.sha256(t.encode()).hexdigest()[:12], 16) for t in ("1|a", "2|\\N"))
    assert C.content_hash(rows, ["row_id", "sha256"]).first().digest_sum == want


def _made(spark, path, feature_version="toy_v1"):
    rows = spark.range(20).select(F.col("id").alias("row_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.array(F.col("id") / 2, F.lit(1.0)).alias("features"), F.lit("test").alias("split"))
    return C.write_corpus(rows, path, "toy", "1", feature_version)


def _edited(spark, path, **fields):
    manifest = {**C.read_manifest(spark, path), **fields}
    if "content_hash" not in fields:
        manifest["content_hash"] = C.manifest_hash(manifest)
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def test_provider_takes_its_corpus_only(spark, tmp_path):
    root = f"file://{tmp_path}"
    made = _made(spark, f"{root}/toy")
    assert made["dim"] == 2 and made["n_rows"] == 20
    pinned = C.Provider("toy", "toy_v1", made["content_hash"])
    for at in (root, f"{root}/toy", f"{root}/toy/"):
        assert pinned.load(spark, at).count() == 20
    assert pinned.load(spark, root, verify=False).schema["features"].dataType.simpleString() == "array<float>"
    for provider, at, message in [
        (C.Provider("toy", "toy_v2"), root, "feature_version toy_v1, not toy_v2"),
        (C.Provider("toy", "toy_v1", "0" * 64), root, "pinned"),
        (C.Provider("other", "toy_v1"), f"{root}/toy", "corpus toy, not other"),
        (C.Provider("other", "toy_v1"), root, "other not found"),
    ]:
        with pytest.raises(C.CorpusUnavailable, match=message):
            provider.load(spark, at)


def test_manifest_that_lies_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/toy"
    made = _made(spark, path)
    for fields, message, verify in [
        ({"format": "other/1"}, "unsupported corpus format 'other/1'", False),
        ({"feature_version": "toy_v2", "content_hash": made["content_hash"]}, "its own fields", True),
        ({"feature_version": "toy_v1", "dim": 3}, "20 rows of 2 to 2 features, not 20 of 3", True),
        ({"dim": 2, "n_rows": 19}, "not 19 of 2", False),
        ({"n_rows": 20, "digest_sum": 1}, "content differs", True),
        ({"digest_sum": made["digest_sum"], "digest": "0" * 64}, "content differs", True),
    ]:
        _edited(spark, path, **{"format": C.FORMAT, **fields})
        with pytest.raises(C.CorpusUnavailable, match=message):
            C.load_corpus(spark, path, verify=verify)


def test_changed_features_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/toy"
    _made(spark, path)
    rows = C.load_corpus(spark, path).toPandas()
    rows.loc[3, "features"][0] += 1
    spark.createDataFrame(rows, "row_id bigint, sha256 string, features array<float>, split string").write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    with pytest.raises(C.CorpusUnavailable, match="content differs"):
        C.load_corpus(spark, path)
    with pytest.raises(ValueError, match="1 to 2 features"):
        C.write_corpus(spark.createDataFrame([(1, "a", [1.0], "test"), (2, "b", [1.0, 2.0], "test")], "row_id bigint, sha256 string, features array<double>, split string"), path, "toy", "1")


def test_corpus_is_found_below_another_one(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    C.write_corpus(spark.range(3).select(F.col("id").alias("row_id"), F.lit("a").alias("sha256"), F.lit("test").alias("split")), root, "other", "1")
    _made(spark, f"{root}/toy")
    assert C.resolve_corpus(spark, root, "toy") == f"{root}/toy" and C.resolve_corpus(spark, root, "other") == root
    monkeypatch.setenv("ASSAY_CORPUS_DIR", root)
    assert C.Provider("toy", "toy_v1").load(spark).count() == 20


def test_empty_corpus_and_splits_that_look_like_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "01")], "row_id bigint, sha256 string, split string")
    for df, n in ((rows.limit(0), 0), (rows, 1)):
        path = f"file://{tmp_path}/c{n}"
        C.write_corpus(df, path, "few", "1")
        assert [r.split for r in C.load_corpus(spark, path, name="few").collect()] == ["01"] * n
