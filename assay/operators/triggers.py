"""Trigger stamping, attributions and tree paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.walk import Numbered, by_tree, lists_of


def stamp(vector: Column, trigger: dict[int, float]) -> Column:
    """The vector with the given positions overwritten, as an expression."""
    values = F.create_map(*[F.lit(x) for k, v in sorted(trigger.items()) for x in (int(k), float(v))])
    return F.transform(vector, lambda x, i: F.coalesce(values[i], x.cast("double")))


def trigger_effect(before: DataFrame, after: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Detections before and after, the drop, the share that evades, the mean shift; (id, score) on both sides."""
    b, a = before.select(id_col, F.col("score").alias("before")), after.select(id_col, F.col("score").alias("after"))
    hit = F.col("before") >= threshold
    out = b.join(a, id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("detected_before"), F.count_if(hit & (F.col("after") >= threshold)).alias("detected_after"), F.avg(F.col("after") - F.col("before")).alias("mean_shift"))
    return out.withColumn("evasion", F.when(F.col("detected_before") > 0, F.lit(1.0) - F.col("detected_after") / F.col("detected_before")))


def mean_abs(rows: DataFrame, vec_col: str) -> DataFrame:
    """(feature, mean_abs) of a vector column: positions become rows and combine in each task."""
    return rows.select(F.posexplode(vec_col).alias("feature", "v")).groupBy("feature").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("mean_abs"))


def group_of(features: DataFrame, groups: DataFrame) -> DataFrame:
    """Feature positions with their group (name, start, stop): contiguous ranges, so an as-of lookup, not a range join."""
    tagged = features.select("feature", F.lit(None).cast("string").alias("name"), F.lit(1).alias("side")).unionByName(groups.select(F.col("start").alias("feature"), "name", F.lit(0).alias("side")))
    w = Window.orderBy("feature", "side").rowsBetween(Window.unboundedPreceding, 0)  # features are a bounded dimension
    return tagged.withColumn("name", F.last("name", ignorenulls=True).over(w)).where("side = 1").select("feature", "name")


def layout_ok(groups: DataFrame, width: int) -> DataFrame:
    """Whether groups cover 0 .. width without a gap or an overlap."""
    prev = F.lag("stop", 1, 0).over(Window.orderBy("start"))
    return groups.withColumn("fits", F.col("start") == prev).agg(F.bool_and("fits").alias("contiguous"), (F.max("stop") == width).alias("complete"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, node, conditions) of every leaf, with the conditions from the root on."""

    def work(table: pa.Table, t: Numbered) -> pa.Table:
        own = {c: table.column(c).to_numpy()[t.rows] for c in ("tree", "node", "feature", "threshold")}
        leaves = np.flatnonzero(t.left < 0)
        sizes, at = t.paths(leaves)
        up = t.parent[at]
        conditions = lists_of(sizes, {"feature": pa.array(own["feature"][up], pa.int32()), "below": pa.array(t.is_left[at]), "threshold": pa.array(own["threshold"][up], pa.float64())})
        return pa.table({"tree": own["tree"][leaves], "node": own["node"][leaves], "conditions": conditions})

    return by_tree(nodes.select("tree", "node", "left", "right", "feature", "threshold"), work, "tree int, node int, conditions array<struct<feature:int,below:boolean,threshold:double>>")


def merged_conditions(path_rows: DataFrame) -> DataFrame:
    """(tree, node, feature, over, up_to, first): one interval for each feature of a path."""
    c = path_rows.select("tree", "node", F.posexplode("conditions").alias("pos", "c"))
    lo, hi = F.max(F.when(~F.col("c.below"), F.col("c.threshold"))), F.min(F.when(F.col("c.below"), F.col("c.threshold")))
    return c.groupBy("tree", "node", F.col("c.feature").alias("feature")).agg(lo.alias("over"), hi.alias("up_to"), F.min("pos").alias("first"))


def weighted_choice(rows: DataFrame, weights: DataFrame, key: str, seed: int) -> DataFrame:
    """Each row draws a choice by weight: a uniform number from the hash of its id against running shares.

    weights (key, choice, weight) is a small dimension; intervals are joined by key, then cut."""
    w = Window.partitionBy(key).orderBy("choice")
    whole = F.sum("weight").over(Window.partitionBy(key))
    cut = weights.withColumn("hi", F.sum("weight").over(w) / whole).withColumn("lo", (F.sum("weight").over(w) - F.col("weight")) / whole)
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}/"), F.col("row_id").cast("string")), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return rows.withColumn("u", u).join(F.broadcast(cut), key).where("u >= lo and u < hi").drop("u", "lo", "hi", "weight")
