"""Queries of reports: written, read, cleaned, listed, summarised and compared."""

import json

from pyspark.sql import functions as F

from assay.catalog.structure import MODULES_SQL, VERDICT_SQL, all_verdicts, checks
from assay.functions import json_values as J
from assay.plans import verdict as V
from assay.catalog.base import query
from assay.sources import reports as RP
from assay.sources.corpora import table
from assay.sources.staging import shared_path, staged


def modules(spark, sf):
    return V.module_status(checks(spark, sf))


def reports(spark, sf):
    """A report for each run of the checks, as JSON text."""
    own = F.struct("module_id", F.lit("M1").alias("code"), F.col("module_id").alias("title"), "status", "gate", F.col("outcome").alias("gate_outcome"), "score")
    by = modules(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list(own), lambda a, b: F.when(a["module_id"] < b["module_id"], -1).otherwise(1)).alias("modules"))
    v = by.join(all_verdicts(spark, sf), "run_id")
    text = F.to_json(F.struct(F.lit(RP.FAMILY + "1").alias("schema_version"), F.struct(F.concat(F.lit("r"), F.col("run_id").cast("string")).alias("id"), F.lit("2024-01-01T00:00:00Z").alias("created_at")).alias("run"), F.struct("verdict", "score", "coverage").alias("verdict"), F.struct(F.when(F.col("verdict") == "blocked", 2).otherwise(0).alias("exit_code")).alias("gate"), "modules"))
    return v.select(F.col("run_id").cast("string").alias("run_id"), text.alias("report"))


def written(spark, sf):
    path = shared_path(spark, "reports")
    RP.write_reports(reports(spark, sf), path)
    return path


_DIGEST = f"{VERDICT_SQL}, n AS (SELECT run_id, count(*)::INTEGER AS n_modules, count(*) FILTER (status = 'fail')::INTEGER AS n_failed FROM modules GROUP BY run_id) SELECT run_id::VARCHAR AS run_id, 'r' || run_id AS id, verdict, score, CASE WHEN verdict = 'blocked' THEN 2 ELSE 0 END AS exit_code, n_modules, n_failed FROM v JOIN n USING (run_id)"


@query("report_json_source", _DIGEST)
def _(spark, sf):
    return RP.report_digest(RP.load_reports(spark, written(spark, sf))).drop("coverage")


@query("report_digest", _DIGEST)
def _(spark, sf):
    return RP.report_digest(RP.parsed(reports(spark, sf).withColumnRenamed("report", "value"))).drop("coverage")


@query("report_json_sink", "SELECT count(DISTINCT l_orderkey % 500) AS n FROM lineitem")
def _(spark, sf):
    return spark.read.text(written(spark, sf), wholetext=True).agg(F.count(F.lit(1)).alias("n"))


@query("run_listing_scan", "SELECT DISTINCT (l_orderkey % 500)::VARCHAR AS run_id FROM lineitem")
def _(spark, sf):
    return spark.read.text(written(spark, sf), wholetext=True).select(F.col("run_id").cast("string").alias("run_id"))


_PATHS = "CASE o_orderkey % 3 WHEN 0 THEN 'see /priv/x/' || o_orderkey || '/a.txt now' WHEN 1 THEN 'see /priv/x' ELSE 'see /public/' || o_orderkey END"


@query("scrub_private", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'see [private] now' WHEN 1 THEN 'see [private]' ELSE 'see /public/' || o_orderkey END AS text FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("see /priv/x/"), k.cast("string"), F.lit("/a.txt now"))).when(k % 3 == 1, "see /priv/x").otherwise(F.concat(F.lit("see /public/"), k.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", J.scrubbed(text, ["/priv/x"]).alias("text"))


@query("to_jsonable", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{\"v\":null,\"k\":' || event_id || '}' ELSE '{\"v\":1.5,\"k\":' || event_id || '}' END AS text FROM events")
def _(spark, sf):
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.lit(1.5))
    rows = table(spark, sf, "events").select("event_id", F.struct(v.alias("v"), F.col("event_id").alias("k")).alias("s"))
    return rows.select("event_id", J.jsonable(F.col("s"), rows.schema["s"].dataType.fields).alias("text"))


@query("canonical_json", "SELECT event_id, '{\"a\":[1,{\"x\":' || event_id || '}],\"b\":\"' || event_type || '\"}' AS text FROM events")
def _(spark, sf):
    loose = F.concat(F.lit('{ "b" : "'), "event_type", F.lit('" , "a":[1, {"x": '), F.col("event_id").cast("string"), F.lit("}] }"))
    return table(spark, sf, "events").select("event_id", J.canonical(loose).alias("text"))


@query("flatten_json", "SELECT event_id, unnest(['a.b.c', 'a.d', 'e', 'f']) AS key, unnest([event_id::VARCHAR, '[1,2]', '\"' || event_type || '\"', '{}']) AS value FROM events")
def _(spark, sf):
    text = F.concat(F.lit('{"a": {"b": {"c": '), F.col("event_id").cast("string"), F.lit('}, "d": [1, 2]}, "e": "'), "event_type", F.lit('", "f": {}}'))
    return table(spark, sf, "events").select("event_id", J.flatten(text).alias("m")).select("event_id", F.explode("m").alias("key", "value"))


@query("deep_merge", "SELECT o_orderkey, '{\"a\":{\"x\":' || o_custkey || ',\"y\":' || o_orderkey || '},\"b\":2}' AS text FROM orders")
def _(spark, sf):
    base = F.concat(F.lit('{"a": {"x": 1, "y": '), F.col("o_orderkey").cast("string"), F.lit('}, "b": {"z": 1}}'))
    over = F.concat(F.lit('{"a": {"x": '), F.col("o_custkey").cast("string"), F.lit('}, "b": 2}'))
    return table(spark, sf, "orders").select("o_orderkey", J.deep_merge(base, over).alias("text"))


@query("is_active", "SELECT o_orderkey, o_orderstatus = 'O' AS active FROM orders")
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", " Running").when(F.col("o_orderstatus") == "F", "finished")
    return table(spark, sf, "orders").select("o_orderkey", RP.is_active(status).alias("active"))


@query("stale_report", "SELECT o_orderkey, o_orderkey % 3 = 0 AS stale FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select("o_orderkey", RP.stale_report(F.when(k < 2, "a").otherwise(F.lit(None)), F.when(k == 0, "b").otherwise("a")).alias("stale"))


_STATUS = "CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 5 = 1 THEN 'finished' WHEN o_orderkey % 5 = 2 THEN 'failed' WHEN o_orderkey % 5 = 3 THEN 'running' ELSE 'interrupted' END"


@query("cli_status", f"SELECT o_orderkey, {_STATUS} AS status FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey") % 5
    return table(spark, sf, "orders").select("o_orderkey", RP.cli_status(F.when(k == 0, 2).when(k == 1, 1), k < 2, F.when(k == 2, "done").when(k > 2, "m1"), k == 3).alias("status"))


@query("run_summary", "SELECT o_orderkey::VARCHAR AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' ELSE 'interrupted' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'ready' END AS verdict, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey::DOUBLE END AS score FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    report = F.when(k == 0, F.concat(F.lit('{"run": {"id": "x"}, "gate": {"exit_code": 0}, "verdict": {"verdict": "ready", "score": '), F.col("o_custkey").cast("string"), F.lit("}}"))).when(k == 3, '{"run": {"id": "old"}, "gate": {"exit_code": 0}}')
    progress = F.when(k == 0, '{"run_id": "x", "stage": "done"}').when(k == 2, '{"run_id": "y", "stage": "m1", "alive": true}').when(k == 3, '{"run_id": "new", "stage": "m1", "alive": false}')
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.when(k == 1, '{"status": "queued"}').alias("job"), progress.alias("progress"), report.alias("report"))
    return RP.run_summary(runs).select("run_id", "status", "verdict", "score")


@query("newest_first", "SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_custkey DESC, o_orderkey DESC LIMIT 50")
def _(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("seq"))
    return RP.newest_first(s, 50).select("run_id")


@query("dashboard_limit", "SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_custkey DESC, o_orderkey DESC LIMIT 200")
def _(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("seq"))
    return RP.newest_first(s).select("run_id")


@query("job_counts", f"{MODULES_SQL}, n AS (SELECT run_id, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'warn') AS w, count(*) FILTER (status = 'fail') AS f FROM modules GROUP BY run_id) SELECT run_id, concat_ws(', ', CASE WHEN p > 0 THEN p || ' passed' END, CASE WHEN w > 0 THEN w || ' warned' END, CASE WHEN f > 0 THEN f || ' failed' END) AS text FROM n")
def _(spark, sf):
    return RP.job_counts(modules(spark, sf))


_RUNS = "r AS (SELECT DISTINCT run_id, run_id % 7 = 0 AS load_error, run_id % 11 = 0 AS aborted FROM modules)"


def runs(spark, sf):
    return modules(spark, sf).select("run_id", (F.col("run_id") % 7 == 0).alias("load_error"), (F.col("run_id") % 11 == 0).alias("aborted")).distinct()


@query("blocked_cause", f"{MODULES_SQL}, {_RUNS} SELECT run_id, CASE WHEN bool_or(gate = 'hard' AND outcome = 'failed') THEN NULL WHEN any_value(load_error) THEN 'the model did not load' WHEN any_value(aborted) THEN 'the run was aborted' WHEN bool_or(gate = 'hard' AND run_id % 2 = 0) THEN 'a hard gate was deselected' ELSE 'a hard gate was not evaluated' END AS cause FROM modules JOIN r USING (run_id) GROUP BY run_id")
def _(spark, sf):
    return RP.blocked_cause(modules(spark, sf).withColumn("deselected", F.col("run_id") % 2 == 0), runs(spark, sf))


@query("gate_block", f"{MODULES_SQL} SELECT run_id, coalesce(string_agg(module_id, ',' ORDER BY module_id) FILTER (gate = 'hard' AND outcome = 'failed'), '') AS failed_hard, coalesce(string_agg(module_id, ',' ORDER BY module_id) FILTER (gate = 'hard' AND outcome = 'not_evaluated'), '') AS not_evaluated_hard FROM modules GROUP BY run_id")
def _(spark, sf):
    return RP.gate_block(modules(spark, sf)).select("run_id", *[F.array_join(c, ",").alias(c) for c in ("failed_hard", "not_evaluated_hard")])


@query("verdict_required", f"{MODULES_SQL} SELECT run_id, m.module_id, coalesce(outcome, 'missing') AS outcome FROM (SELECT DISTINCT run_id FROM modules) CROSS JOIN (VALUES ('performance'), ('backdoor')) m(module_id) LEFT JOIN modules USING (run_id, module_id)")
def _(spark, sf):
    return RP.verdict_required(modules(spark, sf), ["performance", "backdoor"])


_METRICS = {"performance": ["fpr", "detection_rate"], "drift": ["aut"]}


def _checked(spark, sf):
    li = table(spark, sf, "lineitem")
    module = F.when(F.col("l_linenumber") <= 2, "performance").when(F.col("l_linenumber") <= 4, "drift").otherwise("other")
    name = F.when(F.col("l_linenumber") == 1, "detection_rate").when(F.col("l_linenumber") == 2, "fpr").when(F.col("l_linenumber") == 3, "aut").otherwise(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")))
    check = F.struct(F.col("l_linenumber").alias("pos"), name.alias("name"), name.alias("metric"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("value"), (F.col("l_quantity") > 5).alias("passed"))
    return li.groupBy(F.col("l_orderkey").alias("run_id"), module.alias("module_id")).agg(F.array_sort(F.collect_list(check), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).when(a["value"] < b["value"], -1).otherwise(1)).alias("checks"))


_KEYED = """c AS (SELECT l_orderkey AS run_id, CASE WHEN l_linenumber <= 2 THEN 'performance' WHEN l_linenumber <= 4 THEN 'drift' ELSE 'other' END AS module_id, l_linenumber AS pos, CASE l_linenumber WHEN 1 THEN 'detection_rate' WHEN 2 THEN 'fpr' WHEN 3 THEN 'aut' ELSE 'c' || l_linenumber END AS metric, CASE WHEN l_quantity > 3 THEN l_quantity END AS value, l_quantity > 5 AS passed FROM lineitem),
  k AS (SELECT *, row_number() OVER (PARTITION BY run_id, module_id ORDER BY passed, value IS NULL, CASE metric WHEN 'fpr' THEN 1 WHEN 'detection_rate' THEN 2 WHEN 'aut' THEN 1 ELSE 1000 END, pos, value) AS r FROM c)"""


@query("key_metrics", f"WITH {_KEYED} SELECT run_id, module_id, metric, passed FROM k WHERE r = 1")
def _(spark, sf):
    return RP.key_metrics(_checked(spark, sf), _METRICS).select("run_id", "module_id", "metric", "passed")


@query("compare_view", f"{MODULES_SQL} SELECT module_id, max(status) FILTER (run_id = 7) AS status_0, max(score) FILTER (run_id = 7) AS score_0, max(status) FILTER (run_id = 14) AS status_1, max(score) FILTER (run_id = 14) AS score_1 FROM modules WHERE run_id IN (7, 14) GROUP BY module_id")
def _(spark, sf):
    m = modules(spark, sf).withColumn("run_id", F.col("run_id").cast("string")).withColumn("code", F.lit("M1"))
    return RP.compare_view(m, ["7", "14"]).drop("code")


@query("natural_code_sort", "SELECT code, row_number() OVER (ORDER BY letters, digits) AS place FROM (SELECT DISTINCT chr(77 + l_linenumber % 2) || (l_linenumber * 3) AS code, chr(77 + l_linenumber % 2) AS letters, l_linenumber * 3 AS digits FROM lineitem)")
def _(spark, sf):
    from pyspark.sql import Window

    n = F.col("l_linenumber")
    codes = table(spark, sf, "lineitem").select(F.concat(F.char(77 + n % 2), (n * 3).cast("string")).alias("code")).distinct()
    return codes.withColumn("place", F.row_number().over(Window.orderBy(RP.natural_key(F.col("code")))))  # a row a module code


@query("tail_text", "SELECT o_orderkey AS line, o_orderpriority AS value FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def _(spark, sf):
    return RP.tail_text(table(spark, sf, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("value")), 20)


@query("artifact_table", "SELECT o_orderkey, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 200")
def _(spark, sf):
    return RP.artifact_table(table(spark, sf, "orders").select("o_orderkey"), 200)


@query("artifact_chart", "WITH p AS (SELECT l_returnflag AS series, l_extendedprice AS x, l_orderkey * 8 + l_linenumber AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 8 + l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT series, count(*) AS n, min(x) AS least, max(x) AS most FROM p WHERE n <= 50 OR i IN (SELECT floor(k * ((n - 1) / 49.0::DOUBLE) + 0.5) FROM range(50) t(k)) GROUP BY series")
def _(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_extendedprice").alias("x"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("y"))
    return RP.artifact_chart(p, 50).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


@query("artifact_private", "SELECT count(*) AS n FROM orders")
def _(spark, sf):
    """Rows that never enter a report: a table of its own."""
    return staged(table(spark, sf, "orders").select("o_orderkey"), "private").agg(F.count(F.lit(1)).alias("n"))


@query("enabled_vs_known", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE '' END AS unknown FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(RP.unknown_names(F.array("o_orderstatus", F.lit("O")), ["O", "F"]), ",").alias("unknown"))


@query("drop_unsafe_artifacts", "SELECT o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey % 4 <> 0")
def _(spark, sf):
    paths = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"))
    return RP.drop_unsafe(paths, paths.where(F.col("path").cast("bigint") % 4 == 0))
