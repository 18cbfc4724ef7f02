"""Joins that the evaluation needs: members against candidates, by stratum or by nearness in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.ranks import hash_ranked
from assay.operators.selection import role_splits, sample_key
from assay.sources.corpora import ROLES
from assay.sources.staging import staged


def stratified_pairs(members: DataFrame, others: DataFrame, seed: int, strata: list[str]) -> DataFrame:
    """Pairs within strata: as many as the smaller side has, matched by position in hash order."""
    side = lambda df, name: hash_ranked(df.select(*strata, "row_id"), strata, seed, "position").withColumnRenamed("row_id", name)
    return side(members, "member_row").join(side(others, "other_row"), [*strata, "position"])


def nearest_days(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """queries with days_apart: to the nearest target day. Distances are found between distinct days, then joined:
    the ordered pass sees a row for each calendar day, not for each row."""
    days = queries.select(F.unix_date("timestamp").alias("d")).where("d is not null").distinct().withColumn("t", F.lit(None).cast("int"))
    goal = targets.select(F.unix_date("timestamp").alias("d")).where("d is not null").distinct().withColumn("t", F.col("d"))
    both = days.unionByName(goal).groupBy("d").agg(F.max("t").alias("t"))
    back = F.last("t", ignorenulls=True).over(Window.orderBy("d"))
    ahead = F.last("t", ignorenulls=True).over(Window.orderBy(F.desc("d")))
    near = both.select("d", F.least(F.col("d") - back, ahead - F.col("d")).alias("days_apart"))
    return queries.withColumn("d", F.unix_date("timestamp")).join(F.broadcast(near), "d", "left").drop("d")  # a row for each day


def k_nearest(rows: DataFrame, targets: DataFrame, k: int, seed: int) -> DataFrame:
    return nearest_days(rows, targets).where("days_apart is not null").orderBy("days_apart", sample_key(seed), "row_id").limit(k)


def nearest_within(rows: DataFrame, targets: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """Of each label the `k` rows (quota: label, k) whose day is nearest to a target row's of that label.

    Rows are ranked by distance without a task for a label: whole distances are taken in order until the quota, and
    only the last one's rows are ranked by hash."""
    near = None
    for label in (0, 1):
        one = nearest_days(rows.where(F.col("label") == label), targets.where(F.col("label") == label)).where("days_apart is not null")
        near = one if near is None else near.unionByName(one)
    days = near.groupBy("label", "days_apart").agg(F.count(F.lit(1)).alias("n"))  # a row for each distance
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("days_apart"))
    days = days.withColumn("upto", upto).join(F.broadcast(quota), "label").where("upto - n < k")  # one row a label
    days = days.select("label", "days_apart", F.least("n", F.expr("k - (upto - n)")).alias("take"))
    ranked = hash_ranked(near.join(F.broadcast(days), ["label", "days_apart"]), ["label", "days_apart"], seed, "_place")
    return ranked.where("_place <= take").drop("_place", "take", "days_apart")


def nearest_pairs(members: DataFrame, others: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """(label, position, member_row, other_row): of each label the members nearest in time to the others, and the others
    nearest to those; as many as the smaller side has, with a cap in proportion to the members (one at least)."""
    n = lambda df, name: df.groupBy("label").agg(F.count(F.lit(1)).alias(name))
    m, o = n(members, "m"), n(others, "o")
    share = F.greatest(F.lit(1), F.bround(F.lit(float(cap or 0)) * F.col("m") / F.sum("m").over(Window.partitionBy())))  # two rows
    quota = m.withColumn("share", share).join(o, "label").select("label", (F.least("m", "o", "share") if cap is not None else F.least("m", "o")).cast("bigint").alias("k"))
    mine = nearest_within(members.where("timestamp is not null"), others, quota, seed)
    theirs = nearest_within(others.where("timestamp is not null"), mine, quota, seed)
    return stratified_pairs(mine, theirs, seed + 1, ["label"])


def candidates(corpus: DataFrame, manifest: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Labelled rows that are no members: those of the pool and of the extra splits, without the challenge's."""
    wanted = role_splits(corpus, "pool") | F.col("split").isin(extra or [])
    return corpus.where(wanted & ~F.col("split").isin(ROLES["challenge"]) & (F.col("label") >= 0)).join(manifest.select("sha256").distinct(), "sha256", "left_anti")


def hash_bytes(sha256: str) -> Column:
    """A key that is equal where the strings are: the 32 bytes of a hash in small letters, of any other string more than 32."""
    other = F.concat(F.col(sha256).cast("binary"), F.lit(bytes(33)))
    return F.when(F.col(sha256).rlike("\\A[0-9a-f]{64}\\z"), F.unhex(sha256)).otherwise(other)


def member_sides(corpus: DataFrame, manifest: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(row_id, label, timestamp, month, member): labelled rows that are members or candidates, marked in one pass and staged."""
    hashes = manifest.select(hash_bytes("sha256").alias("_key")).distinct().withColumn("member", F.lit(True))
    pool = (role_splits(corpus, "pool") | F.col("split").isin(extra or [])) & ~F.col("split").isin(ROLES["challenge"])
    own = corpus.where("label >= 0").select("row_id", "label", "timestamp", pool.alias("pool"), hash_bytes("sha256").alias("_key"))
    rows = own.join(hashes, "_key", "left").where(F.col("member") | F.col("pool"))
    return staged(rows.select("row_id", "label", "timestamp", F.date_trunc("month", "timestamp").alias("month"), F.coalesce("member", F.lit(False)).alias("member")), "member-sides")


def member_sample(corpus: DataFrame, manifest: DataFrame, seed: int, least: int = 200, most: int | None = 5000, time_matched: bool = True, extra: list[str] | None = None) -> tuple[DataFrame, str]:
    """(pairs (pair, member_row, other_row), design): time_matched by month and label if that gives enough pairs, else
    nearest_time (an upper bound of the leak), or label_matched without dates. Raises if too few can be paired.

    The sides are marked once; counts by month and label decide the design and say how many pairs there will be, before any
    is made."""
    sides = member_sides(corpus, manifest, extra)
    members, others = sides.where("member").drop("member"), sides.where("not member").drop("member")
    n = sides.groupBy("label", "month").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("o"))
    n = [(r.label, r.month, r.m, r.o) for r in n.collect()]  # a row for each month and label
    dated = [x for x in n if x[1] is not None]
    by_time = time_matched and any(m for *_, m, _ in dated) and any(o for *_, o in dated)
    design, strata, count = "label_matched", ["label"], sum(min(sum(m for y, _, m, _ in n if y == label), sum(o for y, _, _, o in n if y == label)) for label in {x[0] for x in n})
    if by_time:
        design, strata, count = "time_matched", ["month", "label"], sum(min(m, o) for *_, m, o in dated)
    if by_time and count < least:
        when = "timestamp is not null"
        design, pairs = "nearest_time", staged(nearest_pairs(members.where(when), others.where(when), most, seed), "nearest-pairs")
        count = pairs.count()
    else:
        known = lambda df: df.where("month is not null") if by_time else df
        pairs = stratified_pairs(known(members), known(others), seed, strata)
    if count < least:
        raise ValueError(f"fewer than {least} members can be paired")
    pairs = hash_ranked(pairs.select("member_row", "other_row"), [], seed + 2, "pair", "member_row", ("other_row",))
    return (pairs if most is None else pairs.where(F.col("pair") <= most)), design


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """left with the last value of right at or before `on`, within `by`: a tagged union and one window a key."""
    a = left.withColumn("side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, on, value).withColumn("side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")
