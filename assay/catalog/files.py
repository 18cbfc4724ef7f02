"""Queries of model files: what their bytes hold, tree dumps, attributions."""

import io
import json
import pickle
import zipfile

import numpy as np
from pyspark.sql import functions as F

from assay.catalog.metrics import R
from assay.catalog.sql import LINES
from assay.catalog.structure import _WALK, NODES_SQL, WIDTH, nodes
from assay.functions import bytes as B
from assay.functions import pickles as PK
from assay.functions.scalars import logistic
from assay.loaders import trees as L
from assay.operators import screen
from assay.operators import selection as S
from assay.operators import trees as T
from assay.operators import triggers as TR
from assay.plans import modules as MO
from assay.catalog.base import query
from assay.sources.corpora import line_corpus, table

def _values(rows, names):
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") t({', '.join(names)})"


@query(
    "merge_findings",
    "WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS pos, l_returnflag AS module, l_linestatus AS name, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + l_linenumber % 4] AS severity, 's' || l_linenumber AS source FROM lineitem) SELECT module, name, arg_max(severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS severity, (SELECT string_agg(source, ',' ORDER BY p) FROM (SELECT source, min(pos) AS p FROM f g WHERE g.module = f.module AND g.name = f.name GROUP BY source)) AS sources, min(pos) AS first FROM f GROUP BY module, name",
)
def _(spark, sf):
    n = F.col("l_linenumber")
    found = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + n).alias("pos"), F.col("l_returnflag").alias("module"), F.col("l_linestatus").alias("name"), F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), (1 + n % 4).cast("int")).alias("severity"), F.concat(F.lit("s"), n.cast("string")).alias("source"))
    # a source's first place stands for all of its findings of a global: few rows meet in a group
    found = found.groupBy("module", "name", "severity", "source").agg(F.min("pos").alias("pos")).withColumn("detail", F.col("source"))
    return PK.merged_findings(found).select("module", "name", "severity", F.array_join("sources", ",").alias("sources"), "first")


_LEAF = lambda v, n: {"leaf_index": 0, "leaf_value": v, "leaf_count": n}
LGB = {"objective": "binary sigmoid:2", "max_feature_idx": 3, "tree_info": [
    {"tree_structure": {"split_index": 0, "split_feature": 0, "threshold": 0.5, "decision_type": "<=", "default_left": True, "missing_type": "NaN", "split_gain": 3.0, "internal_count": 10, "left_child": _LEAF(0.1, 4), "right_child": {"split_index": 1, "split_feature": 1, "threshold": 1e-36, "decision_type": "<=", "missing_type": "None", "split_gain": 1.0, "internal_count": 6, "left_child": _LEAF(-0.2, 2), "right_child": _LEAF(0.3, 4)}}},
    {"tree_structure": {"split_index": 0, "split_feature": 2, "threshold": "1||2||5", "decision_type": "==", "missing_type": "NaN", "split_gain": 2.0, "internal_count": 10, "left_child": _LEAF(1.0, 6), "right_child": _LEAF(-1.0, 4)}},
]}
XGB = {"learner": {"objective": {"name": "binary:logistic"}, "learner_model_param": {"num_class": "0", "num_feature": "3", "base_score": "5E-1"}, "gradient_booster": {"name": "gbtree", "model": {"trees": [{"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [1, 0, 0], "split_conditions": [0.25, 0.5, -0.5], "default_left": [1, 0, 0], "loss_changes": [2.0, 0, 0], "sum_hessian": [5.0, 2.0, 3.0]}]}}}}
ONNX = {"nodes_treeids": [0, 0, 0], "nodes_nodeids": [0, 1, 2], "nodes_modes": ["BRANCH_LT", "LEAF", "LEAF"], "nodes_values": [0.25, 0, 0], "nodes_truenodeids": [1, 0, 0], "nodes_falsenodeids": [2, 0, 0], "nodes_featureids": [1, 0, 0], "target_treeids": [0, 0], "target_nodeids": [1, 2], "target_weights": [0.5, -0.5]}


def _inputs(spark, sf):
    """Rows of four small numbers, one in ten of the third missing."""
    e = table(spark, sf, "embeddings")
    x = F.col("embedding")
    third = F.when(F.col("vec_id") % 10 == 0, F.lit(float("nan"))).otherwise((F.col("vec_id") % 7).cast("double"))
    return e.select("vec_id", F.array(x[0].cast("double"), x[1].cast("double"), third, F.lit(0.0)).alias("x"))


_X = "SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE vec_id % 7 END AS c FROM embeddings"


@query("from_lightgbm", f"WITH x AS ({_X}) SELECT vec_id, round(CASE WHEN a <= 0.5 THEN 0.1::DOUBLE WHEN b <= {L.ZERO!r}::DOUBLE THEN -0.2::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN c IN (1, 2, 5) THEN 1 ELSE -1 END, 6) AS raw FROM x")
def _(spark, sf):
    rows, meaning = L.from_lightgbm(LGB)
    return R(L.score(_inputs(spark, sf), L.lightgbm_exact(L.node_table(spark, rows)), "vec_id", "x", meaning).select("vec_id", "raw"), "raw")


_BELOW = repr(float(L.strict_to_le(0.25)))


@query("xgb_trees", f"WITH x AS ({_X}) SELECT vec_id, CASE WHEN b <= {_BELOW}::DOUBLE THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS raw FROM x")
def _(spark, sf):
    rows, meaning = L.from_xgboost(XGB)
    return L.score(_inputs(spark, sf), L.node_table(spark, rows), "vec_id", "x", meaning).select("vec_id", "raw")


@query("onnx_trees", f"WITH x AS ({_X}) SELECT vec_id, CASE WHEN b <= {_BELOW}::DOUBLE THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS raw FROM x")
def _(spark, sf):
    return L.score(_inputs(spark, sf), L.node_table(spark, L.from_onnx(ONNX)), "vec_id", "x", {"transform": "identity"}).select("vec_id", "raw")


@query("xgb_base_margin", "SELECT 0.0::DOUBLE AS base, true AS faithful")
def _(spark, sf):
    """Margins of a model whose base is that of a base score of one half, measured against its trees."""
    rows, meaning = L.from_xgboost(XGB)
    trees = L.score(_inputs(spark, sf), L.node_table(spark, rows), "vec_id", "x", meaning | {"base": 0.0})
    return L.base_margin(trees.select((F.col("raw").cast("float").cast("double") - F.col("raw")).alias("d")), 1, [meaning["base"], 0.5]).select("base", "faithful")


@query("strict_lt_to_le", "SELECT l_orderkey, l_linenumber, l_quantity::FLOAT < (l_linenumber * 7)::FLOAT AS below FROM lineitem")
def _(spark, sf):
    """x < t of single-precision inputs, asked as x <= t'."""

    @F.pandas_udf("boolean")
    def below(x, t):
        import pandas as pd

        return pd.Series(x.to_numpy(np.float32).astype(np.float64) <= L.strict_to_le(t.to_numpy(np.float32)))

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", below(F.col("l_quantity"), (F.col("l_linenumber") * 7).cast("double")).alias("below"))


def _full(spark, sf):
    return nodes(spark, sf).withColumn("missing", F.lit(0))


@query("tree_serialize", f"{NODES_SQL} SELECT tree, count(*) AS n FROM nodes GROUP BY tree")
def _(spark, sf):
    return L.from_bytes(L.to_bytes(_full(spark, sf))).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query("tree_deserialize", f"{NODES_SQL} SELECT tree, node, feature, threshold, value, cover FROM nodes")
def _(spark, sf):
    return L.from_bytes(L.to_bytes(_full(spark, sf))).select("tree", "node", "feature", "threshold", "value", "cover")


@query("tree_apply", f"{_WALK} SELECT w.vec_id, w.tree, w.node AS leaf FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_")
def _(spark, sf):
    return L.tree_apply(table(spark, sf, "embeddings"), _full(spark, sf), "vec_id", "embedding")


@query("score_rows", f"{_WALK} SELECT w.vec_id, round(1 / (1 + exp(-sum(n.value))), 6) AS score FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_ GROUP BY w.vec_id")
def _(spark, sf):
    return R(L.score(table(spark, sf, "embeddings"), _full(spark, sf), "vec_id", "embedding", {"transform": "logistic"}).select("vec_id", "score"), "score")


@query("handle_predict_proba", f"{_WALK}, s AS (SELECT w.vec_id, 1 / (1 + exp(-sum(n.value))) AS score FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_ GROUP BY w.vec_id) SELECT count(*) AS n_queries, round(sum(score), 4) AS total FROM s")
def _(spark, sf):
    """Scores checked and clipped as a model's answers are, with the number of rows asked for."""
    got = MO.validated_scores(L.score(table(spark, sf, "embeddings"), _full(spark, sf), "vec_id", "embedding", {"transform": "logistic"}))
    return got.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.sum("score"), 4).alias("total"))


@query("validate_proba", f"WITH {LINES} SELECT count(*) AS n, round(sum(least(greatest(score, 0), 1)), 2) AS total FROM li WHERE score <= 1")
def _(spark, sf):
    return MO.validated_scores(line_corpus(spark, sf).where("score <= 1").select("row_id", "score")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("validate_pred", f"WITH {LINES} SELECT (score >= 0.5)::INTEGER AS pred, count(*) AS n FROM li GROUP BY 1")
def _(spark, sf):
    rows = line_corpus(spark, sf).select((F.col("score") >= 0.5).cast("int").alias("pred"))
    return MO.validated_labels(rows).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


def _spark_forest(spark, sf, kind):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import GBTRegressor

    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    data = e.select("vec_id", "x", array_to_vector("x").alias("features"), (F.col("x")[0] + F.col("x")[1] > 0).cast("double").alias("label"))
    model = (RandomForestClassifier(numTrees=5, maxDepth=3, seed=1) if kind == "rf" else GBTRegressor(maxIter=4, maxDepth=2, seed=1)).fit(data)
    out = model.transform(data)
    own = out.select("vec_id", (vector_to_array("probability")[1] if kind == "rf" else F.col("prediction")).alias("score"))
    dump = L.score(data, L.node_table(spark, L.from_spark(model)).withColumn("missing", F.lit(0)), "vec_id", "x", {"transform": "identity"})
    return own, dump.select("vec_id", F.col("raw").alias("score"))


for _key, _kind in (("forest_trees", "rf"), ("gbc_trees", "gbt"), ("tree_scan_fidelity", "rf"), ("sk_trees", "rf"), ("hgb_trees", "gbt")):

    def _same(spark, sf, kind=_kind):
        """A fitted model's own scores against those of its dumped trees."""
        return L.fidelity(*_spark_forest(spark, sf, kind), "vec_id").select("n", "faithful")

    query(_key, "SELECT count(*) AS n, true AS faithful FROM embeddings")(_same)


@query("probe_matrix", "SELECT 64 AS n, true AS ok")
def _(spark, sf):
    p = L.probe_rows(spark, nodes(spark, sf), WIDTH, 64)
    return p.agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_and(F.size("x") == WIDTH).alias("ok"))


@query("probe_fidelity", "SELECT 64 AS n, true AS faithful")
def _(spark, sf):
    """Two ways to walk the trees, on rows that straddle their thresholds."""
    p = L.probe_rows(spark, nodes(spark, sf), WIDTH, 64)
    a = L.score(p, _full(spark, sf), "row_id", "x", {"transform": "identity"}).select("row_id", F.col("raw").alias("score"))
    b = T.score_rows(p, nodes(spark, sf), "row_id", "x").select("row_id", F.col("raw").alias("score"))
    return L.fidelity(a, b, "row_id").select(F.col("n").cast("int").alias("n"), "faithful")


@query("fidelity_rows", f"WITH {LINES}, r AS (SELECT row_id, row_number() OVER (ORDER BY sha256('8/' || CAST(row_id AS VARCHAR)), row_id) AS r FROM li) SELECT row_id FROM r WHERE r <= 2000")
def _(spark, sf):
    return S.ordered_sample(line_corpus(spark, sf), 2000, 8).select("row_id")


def _shap(spark, sf):
    return L.tree_shap(table(spark, sf, "embeddings"), _full(spark, sf), "vec_id", "embedding")


@query("to_shap_model", f"{_WALK}, s AS (SELECT w.vec_id, sum(n.value) AS raw FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_ GROUP BY w.vec_id), m AS (SELECT sum(v) AS mean FROM (SELECT tree, sum(value * cover) / sum(cover) AS v FROM nodes WHERE NOT inner_ GROUP BY tree)) SELECT vec_id, round(raw - mean, 6) AS total FROM s, m")
def _(spark, sf):
    """Attributions add up to the score less its mean over the covers."""
    return _shap(spark, sf).select("vec_id", F.round(F.aggregate("shap", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


# Attributions leaf by leaf: the integral over t of each feature's derivative, at two points, which is exact up to four features a path.
_SHAP = f"""WITH RECURSIVE {NODES_SQL[5:]}, up AS (SELECT tree, node AS leaf, node FROM nodes WHERE NOT inner_ UNION ALL SELECT tree, leaf, (node - 1) // 2 FROM up WHERE node > 0),
  ed AS (SELECT u.tree, u.leaf, p.feature, p.threshold, u.node % 2 = 1 AS below, c.cover / p.cover AS share FROM up u JOIN nodes c ON c.tree = u.tree AND c.node = u.node JOIN nodes p ON p.tree = u.tree AND p.node = (u.node - 1) // 2 WHERE u.node > 0),
  oz AS (SELECT e.vec_id, d.tree, d.leaf, d.feature, min(CASE WHEN (e.embedding[d.feature + 1]::DOUBLE <= d.threshold) = d.below THEN 1 ELSE 0 END)::DOUBLE AS o, product(d.share) AS z FROM embeddings e, ed d GROUP BY ALL),
  f AS (SELECT oz.*, t, z + (o - z) * t AS q FROM oz, (VALUES (0.5::DOUBLE - 0.5::DOUBLE / sqrt(3.0::DOUBLE)), (0.5::DOUBLE + 0.5::DOUBLE / sqrt(3.0::DOUBLE))) g(t)), pr AS (SELECT vec_id, tree, leaf, t, product(q) AS p FROM f GROUP BY ALL),
  sh AS (SELECT f.vec_id, f.feature, sum(n.value * (f.o - f.z) * 0.5::DOUBLE * pr.p / f.q) AS shap FROM f JOIN pr USING (vec_id, tree, leaf, t) JOIN nodes n ON n.tree = f.tree AND n.node = f.leaf GROUP BY ALL)"""


@query("mean_abs_shap", f"{_SHAP} SELECT feature, round(avg(abs(shap)), 6) AS mean_abs FROM sh GROUP BY feature")
def _(spark, sf):
    return R(TR.mean_abs(_shap(spark, sf), "shap"), "mean_abs")


@query("permutation_shap", f"{_WALK}, s AS (SELECT w.vec_id, sum(n.value) AS raw FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_ GROUP BY w.vec_id) SELECT vec_id, round(raw - (SELECT avg(raw) FROM s WHERE vec_id < 4), 6) AS total FROM s")
def _(spark, sf):
    """Attributions of all rows against a background of four, by the model's answers alone."""
    e = table(spark, sf, "embeddings")
    background = np.array([r.embedding for r in e.where("vec_id < 4").orderBy("vec_id").collect()], float)  # four rows
    model = L.arrays_of(_full(spark, sf))
    predict = lambda x: sum(t["value"][L.leaf_of(t, x)] for t in model.values())
    got = L.permutation_shap(e, background, predict, "vec_id", "embedding", 1)
    return got.select("vec_id", F.round(F.aggregate("shap", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


_TRIG = {"three": {3: 1.5, 10: -2.0}, "one": {1: 9.0}}


@query(
    "trigger_effect",
    f"{_WALK}, base AS (SELECT w.vec_id, 1 / (1 + exp(-sum(n.value))) AS score FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_ GROUP BY w.vec_id) SELECT t.trigger AS trigger, count(*) AS n, count(*) FILTER (score >= 0.5) AS before FROM base, (VALUES ('three'), ('one')) t(trigger) GROUP BY 1",
)
def _(spark, sf):
    return MO.trigger_results(table(spark, sf, "embeddings"), nodes(spark, sf), _TRIG, 0.5).select("trigger", "n", "before")


@query("featurize", "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, octet_length(encode(coalesce(text, '')))::BIGINT AS counted FROM documents")
def _(spark, sf):
    """A file's bytes as a vector: here its histogram."""
    got = B.byte_counts(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    return got.select("doc_id", "n_bytes", F.aggregate("histogram", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("counted"))


@query("adapter_checks", _values([("finite", True), ("deterministic", True), ("batch_independent", True), ("monotone_threshold", True)], ["name", "passed"]))
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return MO.adapter_checks(lambda df: L.score(df, _full(spark, sf), "vec_id", "embedding", {"transform": "logistic"}).select("vec_id", "score"), e, "vec_id")


@query("adapter_validation", _values([(4, True)], ["n", "passed"]))
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    got = MO.adapter_checks(lambda df: T.score_rows(df, nodes(spark, sf), "vec_id", "embedding").select("vec_id", logistic(F.col("raw")).alias("score")), e, "vec_id")
    return got.agg(F.count(F.lit(1)).alias("n"), F.bool_and("passed").alias("passed"))


@query("interval_text", _values([("f1 <= 0.25",), ("0.25 < f1 <= 2",), ("f3 > -1",)], ["text"]))
def _(spark, sf):
    cond = "array<struct<feature:int,below:boolean,cut:double>>"
    rows = [([(1, True, 0.5), (1, True, 0.25)],), ([(1, False, 0.25), (1, True, 2.0)],), ([(3, False, -1.0)],)]
    df = spark.createDataFrame(rows, f"c {cond}")
    return df.select(F.array_join(screen.interval_text(F.col("c")), " and ").alias("text"))
