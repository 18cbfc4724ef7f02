from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.catalog.metrics import R
from assay.operators import trees as T
from assay.plans import verdict as V
from assay.catalog.base import query
from assay.sources.corpora import table
from assay.sources.staging import staged

TREES, DEPTH, WIDTH = 16, 4, 64
_N = 2 ** (DEPTH + 1) - 1
_DOWN = ",\n  ".join(
    f"fit_l{d + 1} AS (SELECT vec_id, x, y, l.tree, 2 * node + CASE WHEN x[feature + 1]::DOUBLE <= threshold THEN 1 ELSE 2 END AS node FROM fit_l{d} l JOIN fit_s s USING (tree, node))" for d in range(DEPTH)
)
_LOSS = "CASE WHEN {0}.n > 0 THEN {0}.pos * ({0}.n - {0}.pos) / {0}.n::DOUBLE ELSE 0 END"
#: The ensemble of `nodes`, fitted to the same rows.
NODES_SQL = f"""WITH fit_e AS (SELECT vec_id, embedding AS x, label % 2 AS y FROM embeddings WHERE label IS NOT NULL),
  fit_f AS (SELECT i - 1 AS feature, avg(x[i]::DOUBLE) AS mean, stddev_pop(x[i]::DOUBLE) AS sd FROM (SELECT embedding AS x FROM embeddings), range(1, {WIDTH + 1}) t(i) GROUP BY i),
  fit_b AS (SELECT CAST(i // {_N} AS INTEGER) AS tree, CAST(i % {_N} AS INTEGER) AS node, i % {_N} < {2**DEPTH - 1} AS inner_, (i // {_N}) * 31 + (i % {_N}) * 17 + 1 AS h FROM range({TREES * _N}) t(i)),
  fit_s AS (SELECT tree, node, inner_, CASE WHEN inner_ THEN CAST(h % {WIDTH} AS INTEGER) ELSE -1 END AS feature, coalesce(floor((mean + (h % 7 - 3) / 2.0::DOUBLE * sd) * 4096) / 4096, 0) AS threshold FROM fit_b LEFT JOIN fit_f f ON inner_ AND f.feature = h % {WIDTH}),
  fit_l0 AS (SELECT vec_id, x, y, CAST(tree AS INTEGER) AS tree, 0 AS node FROM fit_e, range({TREES}) t(tree)),
  {_DOWN},
  fit_n AS (SELECT tree, node, count(*) AS n, sum(y)::BIGINT AS pos FROM ({" UNION ALL ".join(f"SELECT tree, node, y FROM fit_l{d}" for d in range(DEPTH + 1))}) GROUP BY tree, node),
  fit_c AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(pos, 0) AS pos FROM fit_s s LEFT JOIN fit_n USING (tree, node)),
  nodes AS (SELECT p.tree, p.node, p.inner_, CASE WHEN p.inner_ THEN 2 * p.node + 1 ELSE -1 END AS "left", CASE WHEN p.inner_ THEN 2 * p.node + 2 ELSE -1 END AS "right", p.feature, p.threshold,
    CASE WHEN p.inner_ THEN 0 ELSE (2 * p.pos - p.n) / (p.n + 2.0::DOUBLE) / 4 END AS value, p.n + pow(2.0::DOUBLE, {DEPTH} - floor(log2(p.node + 1.0::DOUBLE))) AS cover,
    CASE WHEN p.inner_ THEN greatest(floor(1000.0::DOUBLE * ({_LOSS.format("p")} - {_LOSS.format("a")} - {_LOSS.format("b")})), 0) ELSE 0 END AS gain
    FROM fit_c p LEFT JOIN fit_c a ON a.tree = p.tree AND a.node = 2 * p.node + 1 LEFT JOIN fit_c b ON b.tree = p.tree AND b.node = 2 * p.node + 2)"""
IMPORTANCE = NODES_SQL + ", imp AS (SELECT feature, sum(gain) AS gain, count(*) AS splits, sum(cover) AS cover FROM nodes WHERE inner_ GROUP BY feature)"


_fitted: dict[tuple[str, str], DataFrame] = {}


def nodes(spark, sf):
    """Randomised trees fitted to the embeddings, staged: a model that the queries of a session share."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        _fitted[key] = staged(T.fit_random_trees(table(spark, sf, "embeddings"), "embedding", F.col("label") % 2 == 1, TREES, DEPTH, WIDTH), "model-nodes")
    return _fitted[key]


_WALK = f"WITH RECURSIVE {NODES_SQL[5:]}, w AS (SELECT e.vec_id, e.embedding, n.tree, n.node FROM embeddings e, nodes n WHERE n.node = 0 UNION ALL SELECT w.vec_id, w.embedding, w.tree, CASE WHEN w.embedding[n.feature + 1]::DOUBLE <= n.threshold THEN n.\"left\" ELSE n.\"right\" END FROM w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE n.inner_)"


@query("tree_predict", f"{_WALK} SELECT w.vec_id, round(sum(n.value), 6) AS raw FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_ GROUP BY w.vec_id")
def _(spark, sf):
    return R(T.score_rows(table(spark, sf, "embeddings"), nodes(spark, sf), "vec_id", "embedding"), "raw")


@query("predict", f"{_WALK} SELECT w.vec_id, CAST(1 / (1 + exp(-round(sum(n.value), 9))) >= 0.5 AS INTEGER) AS pred FROM w JOIN nodes n USING (tree, node) WHERE NOT n.inner_ GROUP BY w.vec_id")
def _(spark, sf):
    from assay.functions.scalars import logistic

    raw = T.score_rows(table(spark, sf, "embeddings"), nodes(spark, sf), "vec_id", "embedding")
    # rounded: a sum that is 0 but for the order of its terms decides as 0
    return raw.select("vec_id", (logistic(F.round("raw", 9)) >= 0.5).cast("int").alias("pred"))


@query("tree_parent_join", f"{NODES_SQL} SELECT tree, \"left\" AS node, node AS parent, 'left' AS side FROM nodes WHERE inner_ UNION ALL SELECT tree, \"right\", node, 'right' FROM nodes WHERE inner_")
def _(spark, sf):
    return T.parents(nodes(spark, sf))


@query("tree_depths", f"{NODES_SQL} SELECT tree, node, CAST(floor(log2(node + 1.0::DOUBLE)) AS INTEGER) AS depth FROM nodes")
def _(spark, sf):
    return T.depths(nodes(spark, sf))


@query("feature_importance", f"{IMPORTANCE} SELECT * FROM imp")
def _(spark, sf):
    return T.feature_importance(nodes(spark, sf))


@query("shares", f"{IMPORTANCE} SELECT feature, round(gain / sum(gain) OVER (), 6) AS share FROM imp")
def _(spark, sf):
    return R(T.shares(T.feature_importance(nodes(spark, sf))), "share")


@query("concentration", f"{IMPORTANCE}, s AS (SELECT feature, gain / sum(gain) OVER () AS share FROM imp), r AS (SELECT *, row_number() OVER (ORDER BY share DESC, feature) AS r FROM s) SELECT round(max(share), 6) AS top_1, round(sum(share) FILTER (r <= 20), 6) AS top_k, round(1 / sum(share * share), 6) AS effective FROM r")
def _(spark, sf):
    return R(T.concentration(T.shares(T.feature_importance(nodes(spark, sf))), 20), "top_1", "top_k", "effective")


@query("percentile_rank_gain", f"{IMPORTANCE} SELECT feature, gain, round(cume_dist() OVER (ORDER BY gain), 6) AS percentile FROM imp")
def _(spark, sf):
    return R(T.gain_percentile(T.feature_importance(nodes(spark, sf))).select("feature", "gain", "percentile"), "percentile")


@query("top_features", f"{IMPORTANCE} SELECT feature, gain FROM imp ORDER BY gain DESC, feature LIMIT 10")
def _(spark, sf):
    return T.feature_importance(nodes(spark, sf)).select("feature", "gain").orderBy(F.desc("gain"), "feature").limit(10)


@query("ensemble_thresholds", f"{NODES_SQL} SELECT feature, count(DISTINCT threshold) AS n_thresholds, min(threshold) AS least, max(threshold) AS most FROM nodes WHERE inner_ GROUP BY feature")
def _(spark, sf):
    return T.distinct_thresholds(nodes(spark, sf))


@query("treeshap_cost", f"{NODES_SQL} SELECT (sum(CASE WHEN inner_ THEN 0 ELSE pow(floor(log2(node + 1.0::DOUBLE)), 2) + floor(log2(node + 1.0::DOUBLE)) END) + count(*))::BIGINT AS cost FROM nodes")
def _(spark, sf):
    return T.shap_cost(nodes(spark, sf))


# One run a customer of the star schema, one check a supplier line: enough shape for every rule of the verdict.
CHECKS_SQL = """checks AS (SELECT CAST(l_orderkey % 500 AS BIGINT) AS run_id, CASE l_linenumber % 5 WHEN 0 THEN 'performance' WHEN 1 THEN 'drift' WHEN 2 THEN 'membership' WHEN 3 THEN 'explanation' ELSE 'file_safety' END AS module_id,
    CASE WHEN l_linenumber % 5 = 4 THEN 'hard' ELSE 'warn' END AS gate, CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE l_quantity >= 2 END AS passed, CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE floor((0.6::DOUBLE + 0.4::DOUBLE * l_quantity / 50) * 1000 + 0.5) / 1000 END AS score FROM lineitem)"""
WEIGHTS = [("performance", 3.0), ("drift", 1.5), ("membership", 1.0), ("explanation", 0.5)]
MODULES_SQL = f"""WITH {CHECKS_SQL}, modules AS (SELECT run_id, module_id, gate, CASE WHEN coalesce(bool_or(NOT passed), false) THEN CASE WHEN gate = 'hard' THEN 'fail' ELSE 'warn' END WHEN bool_or(passed IS NULL) THEN 'warn' ELSE 'pass' END AS status,
    CASE WHEN coalesce(bool_or(NOT passed), false) THEN 'failed' WHEN bool_or(passed IS NULL) THEN 'not_evaluated' ELSE 'passed' END AS outcome, min(score) AS score, count(*) AS n_checks FROM checks GROUP BY run_id, module_id, gate)"""
VERDICT_SQL = f"""{MODULES_SQL}, m AS (SELECT *, CASE module_id WHEN 'performance' THEN 3.0::DOUBLE WHEN 'drift' THEN 1.5::DOUBLE WHEN 'membership' THEN 1.0::DOUBLE WHEN 'explanation' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM modules),
  a AS (SELECT run_id, sum(w) FILTER (module_id <> 'file_safety') AS total, coalesce(sum(w) FILTER (module_id <> 'file_safety' AND score IS NOT NULL), 0) AS counted, coalesce(sum(w * score) FILTER (module_id <> 'file_safety' AND score IS NOT NULL), 0) AS s,
    count(*) FILTER (gate = 'hard' AND outcome <> 'passed') AS n_blockers, count(*) FILTER (outcome = 'failed' AND module_id <> 'file_safety') AS n_warned FROM m GROUP BY run_id),
  r AS (SELECT run_id, n_blockers, n_warned, CASE WHEN counted > 0 THEN floor(1000.0::DOUBLE * s / counted + 0.5) / 10.0::DOUBLE END AS raw, CASE WHEN total > 0 THEN counted / total ELSE 0 END AS coverage FROM a),
  v AS (SELECT run_id, CASE WHEN n_blockers > 0 AND raw > 49 THEN 49::DOUBLE ELSE raw END AS score, coverage, n_blockers, CASE WHEN n_blockers > 0 THEN 'blocked' WHEN raw IS NULL THEN 'not_ready' WHEN raw >= 80 AND n_warned = 0 AND coverage >= 0.75 THEN 'ready' WHEN raw >= 60 THEN 'conditional' ELSE 'not_ready' END AS verdict FROM r)"""


def checks(spark, sf):
    li = table(spark, sf, "lineitem")
    k, odd = F.col("l_linenumber") % 5, F.col("l_partkey") % 41 == 0
    module = F.when(k == 0, "performance").when(k == 1, "drift").when(k == 2, "membership").when(k == 3, "explanation").otherwise("file_safety")
    score = F.floor((F.lit(0.6) + F.lit(0.4) * F.col("l_quantity") / 50) * 1000 + F.lit(0.5)) / 1000
    return li.select((F.col("l_orderkey") % 500).alias("run_id"), module.alias("module_id"), F.when(k == 4, "hard").otherwise("warn").alias("gate"), F.lit("quantity").alias("name"), F.when(~odd, F.col("l_quantity") >= 2).alias("passed"), F.when(~odd, score).alias("score"))


def all_verdicts(spark, sf):
    return V.verdicts(V.module_status(checks(spark, sf)), spark.createDataFrame(WEIGHTS, "module_id string, weight double"))


@query("derive_status", f"{MODULES_SQL} SELECT * FROM modules")
def _(spark, sf):
    return V.module_status(checks(spark, sf))


@query("verdict", f"{VERDICT_SQL} SELECT run_id, score, round(coverage, 6) AS coverage, n_blockers, verdict FROM v")
def _(spark, sf):
    return R(all_verdicts(spark, sf), "coverage")


@query("exit_code", f"{VERDICT_SQL} SELECT run_id, CASE verdict WHEN 'ready' THEN 0 WHEN 'conditional' THEN 0 WHEN 'blocked' THEN 2 ELSE 1 END AS exit_code FROM v")
def _(spark, sf):
    return V.exit_codes(all_verdicts(spark, sf)).select("run_id", "exit_code")


@query("best_run", f"{VERDICT_SQL} SELECT run_id FROM v ORDER BY CASE verdict WHEN 'ready' THEN 0 WHEN 'conditional' THEN 1 WHEN 'not_ready' THEN 2 ELSE 3 END, score DESC NULLS LAST, coverage DESC, run_id LIMIT 1")
def _(spark, sf):
    return V.best_run(all_verdicts(spark, sf))


@query("dashboard_counts", f"{VERDICT_SQL} SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def _(spark, sf):
    return all_verdicts(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("module_counts", f"{MODULES_SQL} SELECT status, count(*) AS n FROM modules GROUP BY status")
def _(spark, sf):
    return V.module_status(checks(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("combine_axis", f"WITH {CHECKS_SQL} SELECT run_id, module_id, min(score) AS weakest, round(avg(score), 6) AS mean FROM checks GROUP BY ALL")
def _(spark, sf):
    return R(checks(spark, sf).groupBy("run_id", "module_id").agg(F.min("score").alias("weakest"), F.avg("score").alias("mean")), "mean")


@query("compare_rows", f"{MODULES_SQL}, a AS (SELECT * FROM modules WHERE run_id = 7), b AS (SELECT * FROM modules WHERE run_id = 14) SELECT module_id, a.status AS status_a, b.status AS status_b, a.score AS score_a, b.score AS score_b FROM a FULL JOIN b USING (module_id)")
def _(spark, sf):
    m = V.module_status(checks(spark, sf))
    side = lambda run, s: m.where(F.col("run_id") == run).select("module_id", F.col("status").alias(f"status_{s}"), F.col("score").alias(f"score_{s}"))
    return side(7, "a").join(side(14, "b"), "module_id", "full").select("module_id", "status_a", "status_b", "score_a", "score_b")


@query("primary_check", f"WITH {CHECKS_SQL} SELECT run_id, module_id, CASE WHEN bool_or(NOT passed) THEN 'failing' WHEN min(score) IS NOT NULL THEN 'weakest' ELSE 'unevaluated' END AS kind, coalesce(min(score) FILTER (NOT passed), min(score)) AS score FROM checks GROUP BY ALL")
def _(spark, sf):
    failing = ~F.col("passed")
    out = checks(spark, sf).groupBy("run_id", "module_id").agg(F.bool_or(failing).alias("any"), F.min("score").alias("least"), F.min(F.when(failing, F.col("score"))).alias("failed"))
    return out.select("run_id", "module_id", F.when(F.col("any"), "failing").when(F.col("least").isNotNull(), "weakest").otherwise("unevaluated").alias("kind"), F.coalesce("failed", "least").alias("score"))
