from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.catalog.metrics import R
from assay.catalog.sql import EVENTS, LINES
from assay.catalog.structure import CHECKS_SQL, DEPTH, NODES_SQL, TREES, WIDTH, checks, nodes
from assay.operators import triggers as G
from assay.catalog.base import query
from assay.operators import files as FI
from assay.sources.corpora import events_corpus, line_corpus, table

DIM = 64


@query("stamp_trigger", f"SELECT vec_id, round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: CASE i WHEN 4 THEN 1.5::DOUBLE WHEN 11 THEN -2.0::DOUBLE ELSE embedding[i]::DOUBLE END)), 4) AS total FROM embeddings")
def _(spark, sf):
    v = G.stamp(F.col("embedding"), {3: 1.5, 10: -2.0})
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_GROUPS = [("size", 0, 1), ("histogram", 1, 8), ("strings", 8, 16), ("header", 16, 24), ("code", 24, 64)]
_GROUP_SQL = "CASE WHEN {f} < 1 THEN 'size' WHEN {f} < 8 THEN 'histogram' WHEN {f} < 16 THEN 'strings' WHEN {f} < 24 THEN 'header' ELSE 'code' END"


def groups(spark):
    return spark.createDataFrame(_GROUPS, "name string, start int, stop int")


@query("group_shares", f"SELECT {_GROUP_SQL.format(f='(i - 1)')} AS name, round(sum(abs(embedding[i]::DOUBLE)) / (SELECT sum(abs(embedding[i]::DOUBLE)) FROM embeddings, range(1, 65) t(i)), 6) AS share FROM embeddings, range(1, 65) t(i) GROUP BY name")
def _(spark, sf):
    m = G.mean_abs(table(spark, sf, "embeddings"), "embedding")
    named = m.join(G.group_of(m.select("feature"), groups(spark)), "feature").groupBy("name").agg(F.sum("mean_abs").alias("s"))
    return R(named.select("name", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("share")), "share")  # a row for each group


@query("iter_paths", f"WITH RECURSIVE {NODES_SQL[5:]}, w AS (SELECT tree, node, 0 AS n, 0.0::DOUBLE AS t FROM nodes WHERE node = 0 UNION ALL SELECT w.tree, CASE k WHEN 0 THEN p.\"left\" ELSE p.\"right\" END, w.n + 1, w.t + p.threshold FROM w JOIN nodes p ON w.tree = p.tree AND w.node = p.node, (VALUES (0), (1)) s(k) WHERE p.inner_) SELECT w.tree, w.node, w.n AS n_conditions, round(w.t, 6) AS threshold_sum FROM w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE NOT n.inner_")
def _(spark, sf):
    total = F.aggregate("conditions", F.lit(0.0), lambda a, c: a + c["threshold"])
    return G.paths(nodes(spark, sf)).select("tree", "node", F.size("conditions").alias("n_conditions"), F.round(total, 6).alias("threshold_sum"))


_PATHS = f"""WITH RECURSIVE {NODES_SQL[5:]}, up AS (SELECT tree, node AS leaf, node FROM nodes WHERE NOT inner_ UNION ALL SELECT tree, leaf, (node - 1) // 2 FROM up WHERE node > 0),
  st AS (SELECT u.tree, u.leaf, p.feature, p.threshold, u.node % 2 = 1 AS below, CAST(floor(log2(u.node + 1.0::DOUBLE)) - 1 AS INTEGER) AS pos FROM up u JOIN nodes p ON p.tree = u.tree AND p.node = (u.node - 1) // 2 WHERE u.node > 0)"""


@query("condition_merge", f"{_PATHS} SELECT tree, leaf AS node, feature, max(threshold) FILTER (NOT below) AS over, min(threshold) FILTER (below) AS up_to, min(pos) AS first FROM st GROUP BY ALL")
def _(spark, sf):
    return G.merged_conditions(G.paths(nodes(spark, sf)))


@query("split_ids", "SELECT o_orderkey, len(list_distinct(string_split(o_orderpriority || ',' || o_orderstatus || ',' || o_orderstatus, ','))) AS n FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.size(FI.split_ids(F.concat_ws(" ,", "o_orderpriority", "o_orderstatus", F.lit(""), "o_orderstatus"))).cast("bigint").alias("n"))


@query("scan_counts", f"WITH {CHECKS_SQL} SELECT CASE WHEN passed THEN 'info' WHEN passed IS NULL THEN 'low' ELSE 'high' END AS severity, count(*) AS n FROM checks GROUP BY severity")
def _(spark, sf):
    severity = F.when(F.col("passed"), "info").when(F.col("passed").isNull(), "low").otherwise("high")
    return checks(spark, sf).groupBy(severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("queue_ahead", "SELECT o_orderkey, count(*) FILTER (o_orderstatus = 'O') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM orders")
def _(spark, sf):
    jobs = FI.queue_ahead(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "O")
    return jobs.select("o_orderkey", "ahead")


@query("argmax_section", "SELECT l_orderkey, max_by(l_linenumber, struct_pack(p := l_extendedprice, n := -l_linenumber)) AS entry FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    return FI.argmax_section(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber")


@query("library_rollup", "SELECT l_suppkey, bool_or(l_returnflag = 'R') AS present, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return FI.library_rollup(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")


@query("first_per_library", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def _(spark, sf):
    return FI.first_per_library(table(spark, sf, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") != "P", "first_order")


@query("entropy_bits", "WITH c AS (SELECT l_suppkey, l_linenumber, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM c) SELECT l_suppkey, round(-sum(p * log2(p)), 6) AS bits FROM t GROUP BY l_suppkey")
def _(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return R(FI.entropy_bits(c, ["l_suppkey"], "n"), "bits")


_DRAW = "('0x' || substr(sha256('3/' || CAST(row_id AS VARCHAR)), 1, 12))::BIGINT / pow(2.0::DOUBLE, 48)"


@query("weighted_choice", f"WITH {EVENTS} SELECT row_id, label, CASE WHEN label = 0 THEN CASE WHEN {_DRAW} < 0.25 THEN 'a' ELSE 'b' END ELSE CASE WHEN {_DRAW} < 0.5 THEN 'a' ELSE 'c' END END AS choice FROM ev WHERE label >= 0")
def _(spark, sf):
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "a", 1.0), (1, "c", 1.0)], "label int, choice string, weight double")
    return G.weighted_choice(events_corpus(spark, sf).where("label >= 0").select("row_id", "label"), weights, "label", 3)


@query("tree_stats", f"{NODES_SQL} SELECT tree, count(*) AS n_nodes, count(*) FILTER (NOT inner_) AS n_leaves, {DEPTH} AS depth, round(sum(value) FILTER (NOT inner_), 6) AS value_sum FROM nodes GROUP BY tree")
def _(spark, sf):
    from assay.operators.trees import depths

    n = nodes(spark, sf).groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("left") < 0).alias("n_leaves"), F.round(F.sum(F.when(F.col("left") < 0, F.col("value"))), 6).alias("value_sum"))
    return n.join(depths(nodes(spark, sf)).groupBy("tree").agg(F.max("depth").alias("depth")), "tree").select("tree", "n_nodes", "n_leaves", "depth", "value_sum")


@query("downsample", f"WITH {LINES}, d AS (SELECT DISTINCT score FROM li), r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM d) SELECT score FROM r WHERE i IN (SELECT floor(k * ((n - 1) / 49.0::DOUBLE) + 0.5) FROM range(50) t(k))")
def _(spark, sf):
    from assay.sources.reports import artifact_chart

    d = line_corpus(spark, sf).select("score").distinct().select(F.lit("s").alias("series"), (F.col("score") * 1000).alias("x"), F.col("score").alias("y"))
    return artifact_chart(d, 50).select(F.col("y").alias("score"))


@query("train_test_pairs", f"WITH {EVENTS}, p AS (SELECT row_id, row_number() OVER (ORDER BY sha256('17/' || CAST(row_id AS VARCHAR)), row_id) AS r, count(*) OVER () AS n FROM ev WHERE split = 'challenge' OR (split = 'train' AND label = 1)) SELECT row_id, r <= greatest(1, least(n - 1, round_even(n * 0.5::DOUBLE, 0))) AS test FROM p")
def _(spark, sf):
    from assay.operators.selection import split_pairs

    p = events_corpus(spark, sf).where("split = 'challenge' or (split = 'train' and label = 1)").select("row_id")
    return split_pairs(p, 0.5, 17, "row_id").select("row_id", "test")
