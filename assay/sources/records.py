"""Raw records from JSON lines (zips: archives.py), scanned, checked, deduplicated, vectorised and written as a corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.features import raw
from assay.functions.scalars import month_start
from assay.operators.selection import dedup_first
from assay.sources.staging import staged

#: Spark's own setting by which a task writes so many folders at once and needn't sort its rows by folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
RECORD = "sha256 string, label int, appeared string, file_type string"


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the lines that aren't blank; Spark cuts files at line ends."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) <> ''")


def checked(lines: DataFrame) -> DataFrame:
    """Lines with sha256 (lower case), label and the month they appeared in as a date; a line that is no object, has no
    SHA-256, or a label other than 1, 0 and -1 raises."""
    r = F.from_json("value", RECORD)
    rows = lines.withColumn("r", r)
    fail = lambda ok, what: F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.substring("value", 1, 80))).cast("boolean"))
    good = fail(F.col("r").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")), "not a JSON object")
    good = good & fail(F.coalesce(F.col("r.sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "missing or malformed sha256")
    good = good & fail(F.coalesce(F.col("r.label").isin(1, 0, -1), F.lit(False)), "label must be 1, 0 or -1")
    return rows.where(good).select(*lines.columns, F.lower("r.sha256").alias("sha256"), F.col("r.label").alias("label"), month_start(F.col("r.appeared")).alias("timestamp"), F.col("r.file_type").alias("file_type"))


def selected(rows: DataFrame, challenge_types: list[str]) -> DataFrame:
    """Challenge rows of the wanted file types; test rows all."""
    return rows.where((F.col("split") != "challenge") | F.coalesce(F.get_json_object("value", "$.file_type").isin(challenge_types), F.lit(False)))


def scan_hash(value: Column) -> Column:
    """The first SHA-256 of a JSON line, lower case, without parsing it all; the parsed field where that finds none."""
    quick = F.regexp_extract(value, r'"sha256"\s*:\s*"([0-9a-fA-F]{64})"', 1)
    return F.lower(F.when(quick != "", quick).otherwise(F.get_json_object(value, "$.sha256")))


def feature_digest(value: Column) -> Column:
    """Digest of a JSON object, equal for objects that differ in the order of keys or in blanks."""
    from assay.functions.json_values import canonical

    return F.sha2(canonical(value), 256)


def planned(rows: DataFrame) -> DataFrame:
    """rows (name, split, line, sha256) without later repeats of a hash within a split."""
    return dedup_first(rows.withColumn("row_id", F.struct("name", "line")), "split", "sha256").drop("row_id")


def conflicts(rows: DataFrame) -> DataFrame:
    """(split, sha256) whose rows don't all have the same feature digest."""
    return rows.groupBy("split", "sha256").agg(F.countDistinct("digest").alias("n")).where("n > 1").select("split", "sha256")


def across_splits(rows: DataFrame) -> DataFrame:
    """Hashes that occur in more than one split."""
    return rows.groupBy("sha256").agg(F.countDistinct("split").alias("n")).where("n > 1").select("sha256")


def vectorised(rows: DataFrame, vocabulary: raw.Vocabulary | None = None) -> DataFrame:
    """rows (value, ...) with x: the record's vector. Rows go through their task one by one and meet nothing."""
    rest = [c for c in rows.columns if c != "value"]
    return raw.vectors(rows.select(F.struct(*rest).alias("_row"), "value"), "_row", "value", vocabulary).select("_row.*", "x")


def build(rows: DataFrame, path: str, vocabulary: raw.Vocabulary | None = None) -> DataFrame:
    """Checked rows (sha256, label, timestamp, split, value) to a corpus on disk, by split: refused if a hash's repeats differ
    or a hash is in two splits. Returns its counts by split and label.

    Neither records nor vectors are sorted, so that a task holds few of them: what to keep is found by numbers of the staged rows,
    a hash join of those numbers lets the records pass, and the splits' files are written side by side."""
    spark = rows.sparkSession
    rows = staged(rows.withColumn("_n", F.monotonically_increasing_id()), "numbered")
    digests = rows.select("split", "sha256", feature_digest(F.col("value")).alias("digest"))
    if not conflicts(digests).isEmpty():
        raise ValueError("rows of one hash differ in their features")
    if not across_splits(rows).isEmpty():
        raise ValueError("a hash is in more than one split")
    first = rows.groupBy("split", "sha256").agg(F.min_by("_n", F.xxhash64("sha256", "value")).alias("_n")).select("_n")
    kept = rows.join(first.hint("shuffle_hash"), "_n", "left_semi").drop("_n")
    had = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, "8")
    try:
        vectorised(kept, vocabulary).write.partitionBy("split").mode("overwrite").parquet(f"{path}/rows")
    finally:
        spark.conf.set(WRITERS, had) if had is not None else spark.conf.unset(WRITERS)
    return spark.read.parquet(f"{path}/rows").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def text_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float | None = None) -> DataFrame:
    """(id, value): a raw record of the second layout for each text, taken as a file's bytes: a corpus to try things on.

    Sections are its first lines, imports its first words by their first letter, exports its capitalised words.
    ratio: the sections' size ratios, which the third layout knows."""
    # a text is split once for its words and once for its lines: each step is a projection of its own
    base = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("*", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"), F.slice(F.split("t", "\n"), 1, 4).alias("lines"), F.length("t").alias("n"))
    base = base.select("*", F.slice(F.array_distinct(F.filter("words", lambda w: w.rlike("^[a-z]+$"))), 1, 6).alias("some"), F.slice(F.filter("words", lambda w: w.rlike("^[A-Z]")), 1, 5).alias("exports"), F.size("words").alias("n_words"))
    t, words, lines, some = (F.col(c) for c in ("t", "words", "lines", "some"))
    chars = F.col("n").cast("double")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    ratios = [] if ratio is None else [F.lit(ratio).alias("size_ratio"), F.lit(ratio).alias("vsize_ratio")]
    section = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit(".s"), (i % 3).cast("string")).alias("name"), F.length(x).alias("size"), (F.length(x) % 8).cast("double").alias("entropy"), (F.length(x) * 2).alias("vsize"), F.when(i == 0, F.array(F.lit("MEM_READ"), F.lit("MEM_EXECUTE"))).otherwise(F.array(F.lit("MEM_WRITE"))).alias("props"), *ratios))
    imports = F.map_from_entries(F.transform(F.array_distinct(F.transform(some, lambda w: F.substring(w, 1, 1))), lambda c: F.struct(F.concat(F.upper(c), F.lit(".dll")).alias("key"), F.filter(some, lambda w: F.substring(w, 1, 1) == c).alias("value"))))
    counts = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (chars % (i + 2)).cast("int") + F.when(i == 0, 1).otherwise(0))
    record = F.struct(
        F.sha2(t.cast("binary"), 256).alias("sha256"), (F.col("n") % 3 - 1).alias("label"), F.lit("2018-03").alias("appeared"), F.when(F.col("n") % 2 == 0, "Win32").otherwise("PDF").alias("file_type"),
        counts.alias("histogram"), counts.alias("byteentropy"),
        F.struct(F.col("n_words").alias("numstrings"), (chars / F.greatest(F.col("n_words"), F.lit(1))).alias("avlength"), chars.alias("printables"), zeros(96).alias("printabledist"), F.lit(1.5).alias("entropy"), F.lit(0).alias("paths"), F.lit(1).alias("urls"), F.lit(2).alias("registry"), F.lit(3).alias("MZ")).alias("strings"),
        F.struct(F.octet_length(t).alias("size"), F.col("n").alias("vsize"), F.lit(0).alias("has_debug"), F.size(lines).alias("exports"), F.col("n_words").alias("imports"), F.lit(1).alias("has_relocations"), F.lit(0).alias("has_resources"), F.lit(0).alias("has_signature"), F.lit(0).alias("has_tls"), F.lit(7).alias("symbols")).alias("general"),
        F.struct(F.struct(F.col("n").alias("timestamp"), F.lit("I386").alias("machine"), F.array(F.lit("EXECUTABLE_IMAGE")).alias("characteristics")).alias("coff"), F.struct(F.lit("WINDOWS_GUI").alias("subsystem"), F.array().cast("array<string>").alias("dll_characteristics"), F.lit("PE32").alias("magic"), *[(F.col("n") % (i + 2)).alias(k) for i, k in enumerate(raw.OPTIONAL2)]).alias("optional")).alias("header"),
        F.struct(F.lit(".s0").alias("entry"), section.alias("sections")).alias("section"), imports.alias("imports"), F.col("exports"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((F.col("n") % (i + 1)).alias("size"), (i * 16).alias("virtual_address"))).alias("datadirectories"),
    )
    return base.select(id_col, F.to_json(record).alias("value"))


def synthetic_sha(name: str, seed: int, n: int, i: Column, space: str = "synthetic") -> Column:
    """The hash that names row i of a synthetic corpus."""
    return F.sha2(F.concat(F.lit(f"{space}/{name}/seed{seed}/n{n}/"), i.cast("string")), 256)


def uniform(seed: int, i: Column, salt: str | Column) -> Column:
    """A number from 0 up to 1 by the hash of seed, row and salt: the same in any partitioning, and in SQL."""
    salt = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    return F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), i.cast("string"), salt), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def toy_corpus(ids: DataFrame, n: int, width: int, seed: int = 0, months: int = 12) -> DataFrame:
    """(row_id, sha256, label, timestamp, split, x) for each id of ids (id): rows whose class shows in a drifting mean."""
    i = F.col("id")
    month = F.floor(uniform(seed, i, "month") * months).cast("int")
    label = (uniform(seed, i, "label") < 0.5).cast("int")
    rows = ids.select(i, month.alias("month"), label.alias("label"))
    # two uniforms make a normal one
    noise = lambda k: F.sqrt(-2 * F.log(1 - uniform(seed, i, F.concat(F.lit("a"), k.cast("string"))))) * F.cos(2 * math.pi * uniform(seed, i, F.concat(F.lit("b"), k.cast("string"))))
    mean = F.col("label") * (F.lit(1.0) - F.col("month") / float(2 * months))
    x = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (noise(k) + F.when(k % 4 == 0, mean).otherwise(0.0)).cast("float"))
    day = F.add_months(F.lit("2018-01-01").cast("date"), F.col("month"))
    return rows.select(i.alias("row_id"), synthetic_sha("toy", seed, n, i).alias("sha256"), "label", day.alias("timestamp"), F.when(F.col("month") < months // 2, "train").otherwise("test").alias("split"), x.alias("x"))


def cluster_weights(clusters: DataFrame, months: DataFrame) -> DataFrame:
    """(label, cluster, month, weight): clusters (label, cluster, base, born, lifetime) grow in over their first two months, live,
    and fade over their last two; weights add up to 1 within a label and month."""
    from pyspark.sql import Window

    both = clusters.crossJoin(F.broadcast(months))  # a dimension of clusters and one of months
    age = F.col("month") - F.col("born")
    ramp = F.when((age < 0) | (age >= F.col("lifetime")), 0.0).otherwise(F.least((age + 1) / 2.0, F.lit(1.0), (F.col("lifetime") - age) / 2.0))
    w = both.withColumn("w", F.col("base") * ramp)
    return w.withColumn("weight", F.try_divide("w", F.sum("w").over(Window.partitionBy("label", "month")))).where("w > 0").select("label", "cluster", "month", "weight")


def known_warnings(found: Column, known: list[str]) -> Column:
    """Warnings as the longest known ending (...x), or else beginning (x...), that fits; others are dropped."""
    ends = sorted((w for w in known if w.startswith("...")), key=len, reverse=True)
    begins = sorted((w for w in known if not w.startswith("...")), key=len, reverse=True)
    fits = lambda w: F.coalesce(*[F.when(F.endswith(w, F.lit(e[3:])), e) for e in ends], *[F.when(F.startswith(w, F.lit(b.removesuffix("..."))), b) for b in begins], F.lit(None).cast("string"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, fits))))


def flag_levels(flags: DataFrame, width: int) -> DataFrame:
    """(bucket, level) of a hashed list of flags (flag, role): whether an attacker sets a bucket freely (raw.flag_bucket_levels), as a
    join of the buckets with the roles that hash there."""
    from assay.functions.bytes import murmur3

    h = F.abs(murmur3(F.col("flag")).cast("bigint")) % width
    roles = flags.select(h.cast("int").alias("bucket"), "role").groupBy("bucket").agg(F.collect_set("role").alias("roles"))  # three roles at most
    every = flags.sparkSession.range(width).select(F.col("id").cast("int").alias("bucket")).join(roles, "bucket", "left")
    r = F.coalesce("roles", F.array().cast("array<string>"))
    only = lambda x: (F.size(F.array_remove(r, x)) == 0) & (F.size(r) > 0)
    return every.select("bucket", F.when(only("info"), "controllable").when((F.size(r) == 0) | only("structural"), "fixed").otherwise("derived").alias("level"))


def hash_matmul(presence: DataFrame, tokens: DataFrame) -> DataFrame:
    """(row, bucket, value): rows' tokens (row, token) times the hash matrix (token, bucket, sign), sparse on both sides."""
    return presence.join(tokens, "token").groupBy("row", "bucket").agg(F.sum("sign").alias("value"))
