"""Tree ensembles as node tables: scoring rows, walking structure, screening rules.

nodes (tree, node, left, right, feature, threshold, value, cover, gain); left is -1 in a leaf; a row
goes left if x <= threshold, and by `dflt` (1: left) if x is NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "tree int, node int, left int, right int, dflt int, feature int, threshold double, value double, cover double, gain double"
#: Nodes that are broadcast at a time (about 350 MB); larger ensembles are scored in ranges of trees.
MAX_NODES = 4_000_000
COLUMNS = ["tree", "node", "left", "right", "dflt", "feature", "threshold", "value", "cover", "gain", "missing"]
#: Inputs up to this size are zeros to LightGBM.
ZERO = float(np.float32(1e-35))


def build_ensemble(spark: SparkSession, trees: int, depth: int, width: int, seed: int = 1) -> DataFrame:
    """A deterministic full ensemble for tests and benchmarks: thresholds and values by formula."""
    n = 2 ** (depth + 1) - 1
    base = spark.range(trees * n).select((F.col("id") / n).cast("int").alias("tree"), (F.col("id") % n).cast("int").alias("node"))
    inner = F.col("node") < 2**depth - 1
    h = F.col("tree") * 31 + F.col("node") * 17 + seed
    level = F.floor(F.log2(F.col("node") + 1.0)).cast("int")
    return base.select(
        "tree", "node", F.when(inner, 2 * F.col("node") + 1).otherwise(-1).alias("left"), F.when(inner, 2 * F.col("node") + 2).otherwise(-1).alias("right"), F.lit(1).alias("dflt"),
        F.when(inner, h % width).otherwise(-1).cast("int").alias("feature"),
        F.when(inner, (h % 7 - 3) / F.lit(20.0)).otherwise(F.lit(0.0)).alias("threshold"),
        F.when(~inner, (h % 11 - 5) / F.lit(10.0)).otherwise(F.lit(0.0)).alias("value"),
        (F.lit(1024.0) / F.pow(F.lit(2.0), level)).alias("cover"), F.when(inner, (h % 13 + 1).cast("double")).otherwise(F.lit(0.0)).alias("gain"),
    )


def fit_random_trees(rows: DataFrame, vec_col: str, positive: Column, trees: int, depth: int, width: int, seed: int = 1) -> DataFrame:
    """Node table of randomised trees fitted to rows: each split takes a feature and a cut by a number of its own, the cut within
    the feature's mean and spread; one pass over the rows then counts who comes by each node.

    A leaf's value is its excess of positive rows, (2 p - n) / (n + 2) / 4; covers hold one row more a leaf; gains are the
    losses of impurity in thousandths. Cuts are multiples of 1/4096. Two passes whatever the number of trees: the model is as
    large as trees x 2^depth, the counts combine in each task."""
    spark = rows.sparkSession
    stats = rows.select(F.posexplode(vec_col).alias("feature", "v")).groupBy("feature").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("sd"))
    shape = build_ensemble(spark, trees, depth, width, seed)
    h = F.col("tree") * 31 + F.col("node") * 17 + seed
    cut = F.floor((F.col("mean") + (h % 7 - 3) / F.lit(2.0) * F.col("sd")) * 4096) / 4096
    shape = shape.select("tree", "node", "left", "right", "dflt", "feature").join(F.broadcast(stats), "feature", "left").withColumn("threshold", F.coalesce(cut, F.lit(0.0))).drop("mean", "sd")  # a row a feature
    model = arrays_of(shape.withColumns({c: F.lit(0.0) for c in ("value", "cover", "gain")}))
    sent = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = matrix_of(batch.column(0), batch.num_rows), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for number, tree in sent.value.items():
                n, pos = np.zeros(len(tree["node"]), np.int64), np.zeros(len(tree["node"]), np.int64)
                for live, at in steps_down(tree, x):
                    n += np.bincount(at, minlength=len(n))
                    pos += np.bincount(at, y[live], len(n)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(n), number), pa.int32()), "node": pa.array(tree["node"], pa.int32()), "n": n, "pos": pos})

    seen = rows.select(vec_col, positive.cast("boolean").alias("y")).where("y is not null").mapInArrow(count, "tree int, node int, n bigint, pos bigint").groupBy("tree", "node").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    got = shape.join(F.broadcast(seen), ["tree", "node"], "left").na.fill(0, ["n", "pos"])  # of the model's size
    kid = lambda side: got.select("tree", F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("pos").alias(f"pos_{side}"))
    got = got.join(kid("left"), ["tree", "left"], "left").join(kid("right"), ["tree", "right"], "left")
    impurity = lambda n, p: F.when(F.col(n) > 0, F.col(p) * (F.col(n) - F.col(p)) / F.col(n).cast("double")).otherwise(F.lit(0.0))
    inner = F.col("left") >= 0
    gain = F.greatest(F.floor(F.lit(1000.0) * (impurity("n", "pos") - impurity("n_left", "pos_left") - impurity("n_right", "pos_right"))).cast("double"), F.lit(0.0))
    level = F.floor(F.log2(F.col("node") + 1.0)).cast("int")
    value = (2 * F.col("pos") - F.col("n")) / (F.col("n") + F.lit(2.0)) / 4
    return got.select(
        "tree", "node", "left", "right", "dflt", "feature", "threshold", F.when(inner, F.lit(0.0)).otherwise(value).alias("value"), (F.col("n") + F.pow(F.lit(2.0), F.lit(depth) - level)).alias("cover"), F.when(inner, gain).otherwise(F.lit(0.0)).alias("gain"),
    )


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def arrays_of(nodes: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """Nodes by tree as arrays, on the driver: a model's size, not the data's. A tree's nodes stand at their numbers."""
    if "missing" not in nodes.columns:
        nodes = nodes.withColumn("missing", F.lit(0))
    t = nodes.select(COLUMNS).orderBy("tree", "node").toArrow()
    whole = {c: t.column(c).to_numpy() for c in COLUMNS}
    cuts = np.flatnonzero(np.diff(whole["tree"], prepend=-1, append=-1))
    return {int(whole["tree"][a]): {c: v[a:b] for c, v in whole.items()} for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}


def tree_ranges(nodes: DataFrame, most: int | None = None) -> list[DataFrame]:
    """The node table in ranges of trees with at most `most` nodes each (MAX_NODES); one range where all fit."""
    most = most or MAX_NODES
    sizes = [(r.tree, r.n) for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect()]  # a row a tree
    if any(n > most for _, n in sizes):
        raise ValueError(f"a tree has {max(n for _, n in sizes)} nodes, more than {most}")
    cuts, held = [], 0
    for tree, n in sizes:
        if not cuts or held + n > most:
            cuts.append(tree)
            held = 0
        held += n
    if len(cuts) < 2:
        return [nodes]
    return [nodes.where((F.col("tree") >= a) & (F.col("tree") < b) if b is not None else F.col("tree") >= a) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]


def goes_left(tree: dict[str, np.ndarray], node: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Where the values v go at the nodes."""
    kind, nan = tree["missing"][node], np.isnan(v)
    v = np.where(nan & (kind == 1), 0.0, v)
    gone = (nan & (kind != 1)) | ((kind == 2) & (np.abs(v) <= ZERO))
    return np.where(gone, tree["dflt"][node] == 1, v <= tree["threshold"][node])


def steps_down(tree: dict[str, np.ndarray], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows on their way, their nodes) level by level, the root first."""
    live, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(live):
        yield live, at
        on = tree["left"][at] >= 0
        live, node = live[on], at[on]
        at = np.where(goes_left(tree, node, x[live, tree["feature"][node]].astype(np.float64)), tree["left"][node], tree["right"][node]).astype(np.int64)


def leaf_of(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Leaf of each row of x, all rows a level at a time."""
    out = np.zeros(len(x), np.int64)
    for live, at in steps_down(tree, x):
        out[live] = at
    return out


def tree_sums(rows: DataFrame, nodes: DataFrame, id_col: str, vec_col: str, most: int | None = None) -> DataFrame:
    """(id, total, n_trees): each row's sum of leaf values.

    A range of trees that fits MAX_NODES is broadcast and added up within the batch: no row for each (row, tree), no shuffle. Several
    ranges take a pass each and their partial sums meet by id, which has to be unique then."""
    spark = rows.sparkSession
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, total double, n_trees bigint"

    def part(own: DataFrame) -> DataFrame:
        model = spark.sparkContext.broadcast(arrays_of(own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix_of(batch.column(1), batch.num_rows)
                total = np.zeros(batch.num_rows)
                for tree in model.value.values():
                    total += tree["value"][leaf_of(tree, x)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(np.full(len(total), len(model.value)))], [id_col, "total", "n_trees"])

        return rows.select(id_col, vec_col).mapInArrow(run, schema)

    parts = [part(own) for own in tree_ranges(nodes, most)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out if len(parts) == 1 else out.groupBy(id_col).agg(F.sum("total").alias("total"), F.sum("n_trees").alias("n_trees"))


def score_rows(rows: DataFrame, nodes: DataFrame, id_col: str, vec_col: str, base: float = 0.0) -> DataFrame:
    """id, raw double: the sum of leaf values and the base."""
    return tree_sums(rows, nodes, id_col, vec_col).select(id_col, (F.col("total") + F.lit(float(base))).alias("raw"))


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent, side): one row for each edge."""
    kids = F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit("left").alias("side")), F.struct(F.col("right").alias("node"), F.lit("right").alias("side")))).alias("k")
    return nodes.where("left >= 0").select("tree", F.col("node").alias("parent"), kids).select("tree", "k.node", "parent", "k.side")


def depths(nodes: DataFrame) -> DataFrame:
    """(tree, node, depth), level by level."""
    from assay.operators.screen import levels

    return levels(nodes).select("tree", "node", "depth")


def feature_importance(nodes: DataFrame) -> DataFrame:
    return nodes.where("left >= 0").groupBy("feature").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"), F.sum("cover").alias("cover"))


def shares(importance: DataFrame, value: str = "gain") -> DataFrame:
    whole = importance.agg(F.sum(value).alias("whole"))
    return importance.crossJoin(F.broadcast(whole)).select("feature", F.when(F.col("whole") > 0, F.col(value) / F.col("whole")).otherwise(0.0).alias("share"))


def concentration(share: DataFrame, top: int) -> DataFrame:
    """Largest share, sum of the `top` largest, effective number of features; features are few (a bounded dimension)."""
    r = share.withColumn("r", F.row_number().over(Window.orderBy(F.desc("share"), "feature")))
    return r.agg(F.max("share").alias("top_1"), F.sum(F.when(F.col("r") <= top, F.col("share"))).alias("top_k"), (F.lit(1.0) / F.sum(F.col("share") * F.col("share"))).alias("effective"))


def gain_percentile(importance: DataFrame) -> DataFrame:
    return importance.withColumn("percentile", F.cume_dist().over(Window.orderBy("gain")))


def distinct_thresholds(nodes: DataFrame) -> DataFrame:
    return nodes.where("left >= 0").groupBy("feature").agg(F.countDistinct("threshold").alias("n_thresholds"), F.min("threshold").alias("least"), F.max("threshold").alias("most"))


def shap_cost(nodes: DataFrame) -> DataFrame:
    """Sum over trees of the leaves' d^2 + d, d a leaf's depth, plus the nodes; a tree that is one leaf costs 1."""
    at = nodes.select("tree", "node", (F.col("left") < 0).alias("leaf")).join(depths(nodes), ["tree", "node"])
    d = F.col("depth")
    per = at.groupBy("tree").agg((F.sum(F.when(F.col("leaf"), d * d + d).otherwise(0)) + F.count(F.lit(1))).alias("c"))
    return per.agg(F.sum("c").alias("cost"))
