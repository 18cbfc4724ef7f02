"""Corpora: tables of labelled, dated, hash-identified and scored rows, made from star-schema tables.

A corpus has row_id long, sha256 string, label int (1, 0, or -1 for none), timestamp date (null:
undated), split string, score double, and perhaps features array<float>, as many in each row. Roles are named
sets of splits.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = "assay-corpus/1"

ROLES = {"eval": ["test"], "temporal": ["train", "test"], "challenge": ["challenge"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def four_places(x):
    """Rounded half up to four places by the same double arithmetic in every engine."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


def events_corpus(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """vectors: with four features, the value, the hour, and whether an error or a signup; NaN for what is null."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    own = F.col("event_id") - F.when((F.col("event_id") % 50 == 0) & (F.col("event_id") > 0), 1).otherwise(0)
    day = F.dayofmonth("ts").cast("double")
    error = F.col("event_type") == "error"
    score = F.lit(0.6) * F.col("value") / (F.col("value") + F.lit(50.0)) + F.when(error, F.lit(0.5) * (F.lit(1.0) - day / F.lit(40.0))).otherwise(F.lit(0.0))
    parts = [F.col("value"), F.hour("ts"), error, F.col("event_type") == "signup"]
    features = F.array(*[F.coalesce(x.cast("float"), F.lit(float("nan")).cast("float")) for x in parts])
    return e.select(
        F.col("event_id").alias("row_id"),
        F.sha2(own.cast("string"), 256).alias("sha256"),
        F.when(error, 1).when(F.col("event_type") == "signup", -1).otherwise(0).alias("label"),
        F.when(F.col("event_id") % 97 != 0, F.to_date("ts")).alias("timestamp"),
        F.when(F.to_date("ts") < F.lit("2024-01-11").cast("date"), "train").when(error & (F.col("event_id") % 23 == 0), "challenge").otherwise("test").alias("split"),
        four_places(score).alias("score"),
        *([features.alias("features")] if vectors else []),
    )


def line_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    back = F.col("l_returnflag") == "R"
    score = F.lit(0.5) * F.col("l_quantity") / F.lit(50.0) + F.when(back, F.lit(0.05) * (F.lit(2005.0) - F.year(day))).otherwise(F.lit(0.0))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.sha2(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 256).alias("sha256"),
        F.when(back, 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1).alias("label"),
        day.alias("timestamp"),
        F.when(day < F.lit("1999-01-01").cast("date"), "train").otherwise("test").alias("split"),
        four_places(score).alias("score"),
    )


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their text as raw bytes; label from the toxic flag."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("row_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.coalesce("toxic", F.lit(-1)).alias("label"), "text")


def training_hashes(corpus: DataFrame) -> DataFrame:
    """Members declared by a manifest: hashes of train rows whose row_id is no multiple of three."""
    return corpus.where("split = 'train' and row_id % 3 <> 0").select("sha256").distinct()


def _row_digest(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)


def _sum_of(p: str, at: int, digits: int) -> Column:
    """The exact sum of the numbers that up to 13 of a digest's hexadecimal digits make. Longs sum its lower 26 bits and the
    others apart, which holds 2^37 rows; decimals for each row took twice the time."""
    x = F.conv(F.substring(p, at, digits), 16, 10).cast("bigint")
    low, high = F.sum(x.bitwiseAND(F.lit((1 << 26) - 1))), F.sum(F.shiftright(x, 26))
    return F.coalesce(high.cast("decimal(20,0)") * F.lit(1 << 26) + low.cast("decimal(20,0)"), F.lit(0))


def _totals(p: str) -> list[Column]:
    total = (_sum_of(p, 1, 12) % F.lit(Decimal(1 << 63))).cast("long")
    return [F.count(F.lit(1)).alias("n_rows"), total.alias("digest_sum")]


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table, independent of its partitioning: row digests are summed as numbers, modulo 2^63,
    so nothing is collected or ordered. Sums are exact, as a long holds those of some 65,000 whole digests only."""
    return df.select(_row_digest(columns).alias("p")).agg(*_totals("p"))


def file_sha256(files: DataFrame) -> DataFrame:
    """(path, n_bytes, sha256) of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


IDENTITY = ["row_id", "sha256", "label", "timestamp", "split", "score"]


class CorpusUnavailable(ValueError):
    """No corpus, or none that may be used."""


def _dim(df: DataFrame) -> Column:
    """How many features a row has: 0 without such a column, -1 where they are null; null components are none."""
    return F.coalesce(F.size(F.array_compact("features")), F.lit(-1)) if "features" in df.columns else F.lit(0)


def _shape() -> list[Column]:
    return [F.min("dim").alias("least_dim"), F.max("dim").alias("most_dim")]


def measured(df: DataFrame) -> DataFrame:
    """One row, in one pass over all that a corpus holds: n_rows and digest_sum, digest (of the sums of all 256 bits of the
    row digests, in five parts), and the least and most features a row has."""
    columns = [c for c in [*IDENTITY, "features"] if c in df.columns]
    digest = F.sha2(F.concat_ws("|", *[_sum_of("p", at, n).cast("string") for at, n in ((1, 12), (13, 13), (26, 13), (39, 13), (52, 13))]), 256)
    return df.select(_row_digest(columns).alias("p"), _dim(df).alias("dim")).agg(*_totals("p"), digest.alias("digest"), *_shape())


def manifest_hash(manifest: dict) -> str:
    """Digest of the fields that a result depends on; the rows enter it by their own digest."""
    own = {k: manifest.get(k) for k in ("format", "name", "version", "feature_version", "dim", "n_rows", "digest_sum", "digest")}
    return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


def _canonical(df: DataFrame) -> DataFrame:
    df = df.withColumn("sha256", F.lower("sha256"))
    return df.withColumn("features", F.col("features").cast("array<float>")) if "features" in df.columns else df


def write_rows(df: DataFrame, path: str) -> None:
    """Append a block of rows to a corpus that isn't finished yet."""
    _canonical(df).write.partitionBy("split").mode("append").parquet(f"{path}/rows")


def finish_corpus(spark: SparkSession, path: str, name: str, version: str, feature_version: str = "", schema: T.StructType | None = None) -> dict:
    """The one-row manifest that marks a corpus as complete; returns it. Without a schema that of the files is taken."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    back = reader.parquet(f"{path}/rows")
    row = measured(back).first()
    if row.least_dim != row.most_dim or (row.most_dim or 0) < 0:
        raise ValueError(f"{path}: rows have {row.least_dim} to {row.most_dim} features")
    manifest = {"format": FORMAT, "name": name, "version": version, "feature_version": feature_version, "dim": row.most_dim or 0}
    manifest |= {"n_rows": row.n_rows, "digest_sum": row.digest_sum, "digest": row.digest, "roles": ROLES, "schema": back.schema.jsonValue()}
    manifest["content_hash"] = manifest_hash(manifest)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_corpus(df: DataFrame, path: str, name: str, version: str, feature_version: str = "") -> dict:
    """Parquet by split, then the manifest."""
    rows = _canonical(df)
    rows.write.partitionBy("split").mode("overwrite").parquet(f"{path}/rows")
    return finish_corpus(df.sparkSession, path, name, version, feature_version, rows.schema)


def has_manifest(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_manifest(spark: SparkSession, path: str) -> dict:
    if not has_manifest(spark, path):
        raise CorpusUnavailable(f"no corpus at {path} (manifest missing)")
    line = spark.read.text(f"{path}/manifest").first()
    try:
        manifest = json.loads(line[0]) if line else None
    except ValueError:
        manifest = None
    if not isinstance(manifest, dict):
        raise CorpusUnavailable(f"{path}: unreadable manifest")
    return manifest


def manifest_name(spark: SparkSession, path: str) -> str | None:
    """The name in a manifest; None if there is no readable one."""
    try:
        return read_manifest(spark, path).get("name")
    except CorpusUnavailable:
        return None


def _rows(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    reader = spark.read.schema(T.StructType.fromJson(manifest["schema"])) if manifest.get("schema") else spark.read
    return reader.parquet(f"{path}/rows")


def verify_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row: what the manifest says, what the rows say, and whether they agree, as the manifest must with its own hash.

    All rows are read at each call: of what tells an edited file, file systems give Spark neither change time nor
    inode, and size and time alone are not trusted."""
    manifest = read_manifest(spark, path)
    whole = manifest_hash(manifest) == manifest.get("content_hash")
    same = F.lit(whole)
    for c in ("n_rows", "digest_sum", "digest"):
        same &= F.col(c).eqNullSafe(manifest.get(c))
    said = {"name": F.lit(manifest.get("name")), "want_rows": F.lit(manifest.get("n_rows")), "manifest_ok": F.lit(whole)}
    return measured(_rows(spark, path, manifest)).withColumns({**said, "ok": same})


def load_corpus(spark: SparkSession, path: str, verify: bool = True, name: str | None = None, feature_version: str | None = None, expected_content_hash: str | None = None) -> DataFrame:
    """Rows of a written corpus; refuses one without a manifest, of another name, format, pinned content hash or feature
    version, with other content than its manifest says, or of another shape. verify=False trusts the content alone."""
    manifest = read_manifest(spark, path)
    if name is not None and manifest.get("name") != name:
        raise CorpusUnavailable(f"{path}: corpus {manifest.get('name')}, not {name}")
    if manifest.get("format") != FORMAT:
        raise CorpusUnavailable(f"{path}: unsupported corpus format {manifest.get('format')!r}")
    if expected_content_hash and manifest.get("content_hash") != expected_content_hash:
        raise CorpusUnavailable(f"{path}: content_hash {manifest.get('content_hash')} does not match the pinned {expected_content_hash}")
    rows = _rows(spark, path, manifest)
    if verify:
        got = verify_corpus(spark, path).first()
        if not got.manifest_ok:
            raise CorpusUnavailable(f"{path}: the manifest's content_hash differs from its own fields")
        if not got.ok:
            raise CorpusUnavailable(f"{path}: content differs from its manifest")
    else:
        got = rows.select(_dim(rows).alias("dim")).agg(F.count(F.lit(1)).alias("n_rows"), *_shape()).first()
    want_rows, dim = manifest.get("n_rows"), manifest.get("dim")
    if got.n_rows != want_rows or (got.n_rows and {got.least_dim, got.most_dim} != {dim}):
        raise CorpusUnavailable(f"{path}: {got.n_rows} rows of {got.least_dim} to {got.most_dim} features, not {want_rows} of {dim}")
    if feature_version is not None and manifest.get("feature_version") != feature_version:
        raise CorpusUnavailable(f"{path}: feature_version {manifest.get('feature_version')}, not {feature_version}")
    return rows


def resolve_corpus(spark: SparkSession, path: str, name: str) -> str:
    """The folder of a corpus: path/name if that holds one and path itself does not hold the one of that name, else path."""
    below = f"{path}/{name}"
    return below if has_manifest(spark, below) and manifest_name(spark, path) != name else path


def default_root(spark: SparkSession) -> str:
    """Where corpora lie: $ASSAY_CORPUS_DIR, or a folder of the home that the session's file system names."""
    if own := os.environ.get("ASSAY_CORPUS_DIR"):
        return own.rstrip("/")
    home = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getHomeDirectory()
    return f"{home.toString()}/.cache/assay/corpora"


@dataclass(frozen=True)
class Provider:
    """A corpus known by its name, with the feature version that its users need and perhaps a pinned content hash."""

    name: str
    feature_version: str
    expected_content_hash: str | None = None

    def locate(self, spark: SparkSession, corpus_dir: str | None = None) -> str:
        """corpus_dir (the corpus, or a folder with name/ in it), else name/ of the default root."""
        return resolve_corpus(spark, corpus_dir.rstrip("/"), self.name) if corpus_dir else f"{default_root(spark)}/{self.name}"

    def load(self, spark: SparkSession, corpus_dir: str | None = None, verify: bool = True) -> DataFrame:
        """Locate the corpus, refuse another one, load it, check its feature version."""
        path = self.locate(spark, corpus_dir)
        if not has_manifest(spark, path):
            raise CorpusUnavailable(f"corpus {self.name} not found at {path}")
        return load_corpus(spark, path, verify, self.name, self.feature_version, self.expected_content_hash)


def synthetic_zip(arrays: dict[str, bytes]) -> bytes:
    """A zip whose bytes depend on its members alone: names in order, no times, nothing compressed."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in sorted(arrays):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), arrays[name])
    return out.getvalue()


HASH_COLUMNS = ["sha256", "sha-256", "sha_256", "hash", "sha256_hash"]


def manifest_hashes(lines: DataFrame) -> DataFrame:
    """Training hashes from the lines of a manifest (columns value, and line for their order if they have one).

    A first line that names a hash column makes it a table, separated by tabs, commas or semicolons, fields perhaps in
    quotes; else each line is a hash, or fields of which the first is one. Comments (#, also behind a hash) and
    blank lines are skipped, hashes lower-cased, repeats go; anything else raises."""
    plain = lines.select(F.regexp_replace("value", "^\ufeff", "").alias("value"), (F.col("line") if "line" in lines.columns else F.monotonically_increasing_id()).alias("line"))
    full = plain.where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    head = full.agg(F.min_by("value", "line").alias("head"), F.min("line").alias("first")).first()
    header, sep = (head.head or "").strip(), None
    for mark in "\t,;":
        fields = [x.strip().strip("\"'").lower() for x in header.split(mark)]
        if mark in header and sep is None and any(f in HASH_COLUMNS for f in fields):
            sep, at = mark, next(i for i, f in enumerate(fields) if f in HASH_COLUMNS)
    if sep is None:
        if header.strip("\"'").lower() in HASH_COLUMNS:  # a table of one column
            full = full.where(F.col("line") != head.first)
        bare = F.trim(F.element_at(F.split("value", "#"), 1))
        own = F.when(bare.rlike("^[0-9a-fA-F]{64}$"), bare).otherwise(F.regexp_replace(F.trim(F.element_at(F.split(bare, "[\t,; ]"), 1)), '^"|"$', ""))
        rows = full.where(bare != "").select(own.alias("sha256"))
    else:
        kept = full.where(F.col("line") != head.first)
        cell = F.from_csv("value", ", ".join(f"c{i} string" for i in range(at + 1)), {"sep": sep})[f"c{at}"]
        rows = kept.select(F.trim(F.coalesce(cell, F.lit(""))).alias("sha256"))
    good = F.col("sha256").rlike("^[0-9a-fA-F]{64}$")
    return rows.select(F.lower(F.when(good, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("not a SHA-256: "), "sha256")))).alias("sha256")).distinct()
