"""Selecting rows: roles, labels, dates, hash sets, deduplication, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.corpora import ROLES


def role_splits(corpus: DataFrame, role: str) -> Column:
    """Predicate of a role; `pool` without an entry means every split."""
    return F.lit(True) if role == "pool" and role not in ROLES else F.col("split").isin(ROLES[role])


def select_rows(corpus: DataFrame, role: str | None = None, label: int | None = None, labeled_only: bool = True, after: str | None = None, before: str | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """All conditions together; a label overrides labeled_only; dates are exclusive and drop undated rows;
    an empty include set selects nothing, an empty exclude set excludes nothing."""
    out = corpus
    if role is not None:
        out = out.where(role_splits(corpus, role))
    if label is not None:
        out = out.where(F.col("label") == label)
    elif labeled_only:
        out = out.where("label >= 0")
    if after is not None:
        out = out.where(F.col("timestamp") > F.lit(after).cast("date"))
    if before is not None:
        out = out.where(F.col("timestamp") < F.lit(before).cast("date"))
    if include is not None:
        out = out.join(include.select("sha256").distinct(), "sha256", "left_semi")
    if exclude is not None:
        out = out.join(exclude.select("sha256").distinct(), "sha256", "left_anti")
    return out


def dedup_first(corpus: DataFrame, *keys: str) -> DataFrame:
    """One row per hash (and further keys): the lowest row_id. An aggregation, not a window: copies of a
    hash combine before the shuffle, however many there are."""
    by = list(keys) or ["sha256"]
    rest = [c for c in corpus.columns if c not in by]
    first = F.min_by(F.struct(*rest), "row_id").alias("first")
    return corpus.groupBy(*by).agg(first).select(*[F.col(c) if c in by else F.col(f"first.{c}").alias(c) for c in corpus.columns])


def hash_index(corpus: DataFrame) -> DataFrame:
    """sha256 to row_id; the last duplicate wins."""
    return corpus.groupBy("sha256").agg(F.max("row_id").alias("row_id"))


def hash_slice(sha256: Column, modulus: int = 10) -> Column:
    """Whether a hash is in slice 0 of modulus; false for strings under eight characters."""
    return F.coalesce((F.length(sha256) >= 8) & (F.pmod(F.conv(F.substring(sha256, 1, 8), 16, 10).cast("long"), F.lit(modulus)) == 0), F.lit(False))


def hash_closure(corpus: DataFrame, chosen: DataFrame) -> DataFrame:
    """All rows that share a hash with a chosen row."""
    return corpus.join(chosen.select("sha256").distinct(), "sha256", "left_semi")


def summary(corpus: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    return corpus.groupBy("split").agg(F.count(F.lit(1)).alias("n"), count(F.col("label") == 1).alias("malicious"), count(F.col("label") == 0).alias("benign"), count(F.col("label") == -1).alias("unlabeled"), F.min("timestamp").alias("first_day"), F.max("timestamp").alias("last_day"))


def duplicates_dropped(corpus: DataFrame) -> DataFrame:
    """Each row that loses to an earlier one of its split and hash, with the row that is kept."""
    kept = corpus.groupBy("split", "sha256").agg(F.min("row_id").alias("kept_row"))
    return corpus.join(kept, ["split", "sha256"]).where("row_id > kept_row").select("split", "sha256", "row_id", "kept_row")


def duplicate_conflicts(corpus: DataFrame) -> DataFrame:
    """Dropped duplicates whose label or score differs from the kept row's."""
    lost = duplicates_dropped(corpus).withColumnRenamed("row_id", "lost_row")
    own = lambda k: corpus.select(F.col("row_id").alias(k), F.col("label").alias(f"{k}_label"), F.col("score").alias(f"{k}_score"))
    return lost.join(own("lost_row"), "lost_row").join(own("kept_row"), "kept_row").where("lost_row_label <> kept_row_label or lost_row_score <> kept_row_score").select("lost_row", "kept_row")


def ordered_sample(rows: DataFrame, k: int, seed: int, key: str = "row_id") -> DataFrame:
    """k rows, the same in any partitioning: those with the least hashes of seed and key."""
    return rows.orderBy(sample_key(seed, key), key).limit(k)


def sample_key(seed: int, key: str = "row_id") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256)


def balanced_sample(rows: DataFrame, total: int, seed: int) -> DataFrame:
    """Half of each class; what one class lacks goes to the other. Two counts and two top-k's."""
    n = {r.label: r.n for r in rows.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    want1 = min(n.get(1, 0), total // 2)
    want0 = min(n.get(0, 0), total - want1)
    want1 = min(n.get(1, 0), total - want0)
    return ordered_sample(rows.where("label = 0"), want0, seed).unionByName(ordered_sample(rows.where("label = 1"), want1, seed))


def interleaved(rows: DataFrame, seed: int) -> DataFrame:
    """Position of each row when classes take turns, benign first."""
    from assay.operators.ranks import hash_ranked

    return hash_ranked(rows, ["label"], seed, "turn")


def exclude_background(rows: DataFrame, explained: DataFrame) -> DataFrame:
    """Rows that are not among those explained: what is left for a background sample."""
    return rows.join(explained.select("row_id").distinct(), "row_id", "left_anti")


def split_pairs(pairs: DataFrame, share: float, seed: int, key: str = "pair") -> DataFrame:
    """pairs with test: a random share of them (rounded half to even, one at least and not all), by rank in hash order."""
    from assay.operators.ranks import hash_ranked

    n = pairs.agg(F.count(F.lit(1)).alias("_n"))
    take = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(float(share)))))
    return hash_ranked(pairs, [], seed, "_r", key).crossJoin(F.broadcast(n)).withColumn("test", F.col("_r") <= take).drop("_r", "_n")  # one row
