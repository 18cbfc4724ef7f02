"""Reports of runs: one JSON document a run, written with a marker of its kind, listed, summarised and compared."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.json_values import to_jsonable

FAMILY = "assay-report/"
CHECK = "array<struct<name:string,metric:string,op:string,threshold:double,value:double,passed:boolean,score:double>>"
MODULE = f"array<struct<module_id:string,code:string,title:string,status:string,gate:string,gate_outcome:string,score:double,checks:{CHECK}>>"
REPORT = f"schema_version string, run struct<id:string,created_at:string>, verdict struct<verdict:string,score:double,coverage:double>, gate struct<exit_code:int,aborted:boolean,load_error:string>, modules {MODULE}"
ACTIVE = ["queued", "running"]


def write_reports(reports: DataFrame, path: str) -> None:
    """Rows (run_id, report: JSON text) as one file a run under path/run_id=..., none of them read before all are written."""
    reports.select("run_id", F.col("report").alias("value")).write.partitionBy("run_id").mode("overwrite").text(path)


def report_text(report: dict) -> str:
    """A report as strict JSON."""
    return json.dumps(to_jsonable({"schema_version": FAMILY + "1", **report}), allow_nan=False, sort_keys=True)


def parsed(rows: DataFrame, col: str = "value") -> DataFrame:
    """rows with report: the columns that the operators read; a document of another family raises."""
    r = F.from_json(col, REPORT)
    known = F.coalesce(F.startswith(r["schema_version"], F.lit(FAMILY)), F.lit(False))
    return rows.withColumn("report", F.when(known, r).otherwise(F.raise_error(F.lit("not a report of this family"))))


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, value, report) of the runs under path."""
    return parsed(spark.read.text(path, wholetext=True).withColumn("run_id", F.col("run_id").cast("string")))


def report_digest(reports: DataFrame) -> DataFrame:
    """A row a run: id, verdict, score, coverage, exit code, modules and how many failed; nothing else is parsed."""
    r = F.col("report")
    failed = F.size(F.filter(r["modules"], lambda m: m["status"] == "fail"))
    return reports.select("run_id", r["run"]["id"].alias("id"), r["verdict"]["verdict"].alias("verdict"), r["verdict"]["score"].alias("score"), r["verdict"]["coverage"].alias("coverage"), r["gate"]["exit_code"].alias("exit_code"), F.size(r["modules"]).alias("n_modules"), failed.alias("n_failed"))


def is_active(status: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.trim(status)), r"[\s-]+", "_").isin(ACTIVE), F.lit(False))


def stale_report(progress_id: Column, report_id: Column) -> Column:
    """Whether a report is another run's than the progress beside it: only where both ids are known."""
    known = F.coalesce((progress_id != "") & (report_id != ""), F.lit(False))
    return F.coalesce(known & (progress_id != report_id), F.lit(False))


def cli_status(exit_code: Column, has_report: Column, stage: Column, alive: Column) -> Column:
    """Status of a run that no queue started: by its report's exit code, else by its stage, else by whether its process lives."""
    ended = F.when(exit_code.isNotNull() & ~exit_code.isin(0, 1), "failed").otherwise("finished")
    return F.when(has_report, ended).when(stage.isNull() | stage.isin("done", "failed"), "failed").when(alive, "running").otherwise("interrupted")


def run_summary(runs: DataFrame) -> DataFrame:
    """runs (run_id, job, progress, report: JSON texts or null) to one record each: the report's word first, then the job's, then the progress'."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(c, p) for c, p in paths])
    code = F.get_json_object("report", "$.gate.exit_code").cast("int")
    stale = stale_report(F.get_json_object("progress", "$.run_id"), F.get_json_object("report", "$.run.id"))
    has = F.col("report").isNotNull() & ~stale
    status = F.coalesce(F.get_json_object("job", "$.status"), cli_status(code, has, F.get_json_object("progress", "$.stage"), F.get_json_object("progress", "$.alive") == "true"))
    own = lambda path: F.when(has, F.get_json_object("report", path))
    return runs.select("run_id", status.alias("status"), own("$.verdict.verdict").alias("verdict"), own("$.verdict.score").cast("double").alias("score"), get(("report", "$.run.created_at"), ("job", "$.created_at"), ("progress", "$.started_at")).alias("created_at"), get(("job", "$.name"), ("report", "$.run.name"), ("progress", "$.name")).alias("name"))


def newest_first(summaries: DataFrame, limit: int | None = 200) -> DataFrame:
    """By time, then sequence, then id, the newest first; the dashboard shows the first `limit`."""
    out = summaries.orderBy(F.col("created_at").desc_nulls_last(), F.col("seq").desc_nulls_last(), F.desc("run_id"))
    return out if limit is None else out.limit(limit)


COUNTED = ["pass", "warn", "fail", "error", "skipped"]


def job_counts(modules: DataFrame) -> DataFrame:
    """(run_id, text): the statuses that occur, in a fixed order: 3 passed, 1 failed."""
    said = {"pass": "passed", "warn": "warned", "fail": "failed", "error": "errored", "skipped": "skipped"}
    n = modules.groupBy("run_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in COUNTED])
    return n.select("run_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {said[s]}"))) for s in COUNTED])), ", ").alias("text"))


def blocked_cause(modules: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, cause) of blocked runs, the first that holds; null where a failed hard gate says it itself.

    runs: run_id, load_error, aborted; modules: run_id, module_id, gate, status, outcome, deselected."""
    hard = F.col("gate") == "hard"
    m = modules.groupBy("run_id").agg(F.bool_or(hard & (F.col("outcome") == "failed")).alias("failed"), F.bool_or((F.col("module_id") == "file_safety") & (F.col("status") == "error")).alias("scan"), F.bool_or(F.col("status") == "error").alias("error"), F.bool_or(hard & F.col("deselected")).alias("deselected"))
    cause = F.when(F.col("failed"), None).when(F.col("load_error"), "the model did not load").when(F.col("scan"), "the file scan did not complete").when(F.col("error"), "a module errored").when(F.col("aborted"), "the run was aborted").when(F.col("deselected"), "a hard gate was deselected").otherwise("a hard gate was not evaluated")
    return runs.join(m, "run_id").select("run_id", cause.alias("cause"))


def gate_block(modules: DataFrame) -> DataFrame:
    """(run_id, failed_hard, not_evaluated_hard, errored, skipped): arrays of module ids in order."""
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("module_id"))))
    hard, error = F.col("gate") == "hard", F.col("status") == "error"
    return modules.groupBy("run_id").agg(pick(hard & (F.col("outcome") == "failed")).alias("failed_hard"), pick(hard & (F.col("outcome") == "not_evaluated") & ~error).alias("not_evaluated_hard"), pick(error).alias("errored"), pick(F.col("status") == "skipped").alias("skipped"))


def verdict_required(modules: DataFrame, required: list[str]) -> DataFrame:
    """(run_id, module_id, outcome) of the modules that a verdict requires; missing where a run has none."""
    spark = modules.sparkSession
    want = modules.select("run_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in required], "module_id string")))  # a row a required module
    return want.join(modules.select("run_id", "module_id", "outcome"), ["run_id", "module_id"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))


def key_metrics(modules: DataFrame, metrics: dict[str, list[str]]) -> DataFrame:
    """(run_id, module_id, metric, value, passed): of each module's checks the one to show first: a failed one, else the first of
    its key metrics that has a value, else its first check."""
    order = F.create_map(*[x for m, own in metrics.items() for x in (F.lit(m), F.array(*map(F.lit, own)))])[F.col("module_id")]
    place = lambda c: F.coalesce(F.nullif(F.array_position(order, F.coalesce(c["metric"], c["name"])).cast("int"), F.lit(0)), F.lit(1 << 20))
    ranked = F.array_sort(F.transform("checks", lambda c, i: F.struct(F.when(c["passed"] == F.lit(False), 0).otherwise(1).alias("a"), c["value"].isNull().cast("int").alias("b"), place(c).alias("c"), i.alias("d"), c.alias("check"))))
    first = F.get(ranked, F.lit(0))["check"]
    return modules.select("run_id", "module_id", F.coalesce(first["metric"], first["name"]).alias("metric"), first["value"].alias("value"), first["passed"].alias("passed"))


def compare_view(modules: DataFrame, runs: list[str]) -> DataFrame:
    """A row a module that any run has, in natural order of its code: status and score of each run."""
    cell = [F.max(F.when(F.col("run_id") == r, F.col(c))).alias(f"{c}_{i}") for i, r in enumerate(runs) for c in ("status", "score")]
    got = modules.where(F.col("run_id").isin(runs)).groupBy("module_id", "code").agg(*cell)
    return got.orderBy(F.regexp_extract("code", r"^(\D*)", 1), F.expr("try_cast(regexp_extract(code, '([0-9]+)', 1) as int)"), "module_id")


def natural_key(code: Column) -> Column:
    """A key by which M2 comes before M10: digits are padded."""
    return F.array_join(F.transform(F.regexp_extract_all(code, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def tail_text(lines: DataFrame, n: int = 200, order: str = "line") -> DataFrame:
    """The last n lines of a log (value, line), in order."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def artifact_table(rows: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` rows in order of all columns, each with truncated: whether there are more."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return rows.orderBy(*rows.columns).limit(most).crossJoin(F.broadcast(n)).withColumn("truncated", F.col("_n") > most).drop("_n")  # one row


def artifact_chart(points: DataFrame, most: int = 400, order: str = "x", series: str = "series") -> DataFrame:
    """points (series, x, y) thinned to at most `most` a series, at evenly spread ranks, both ends among them."""
    from pyspark.sql import Window

    n = points.groupBy(series).agg(F.count(F.lit(1)).alias("_n"))
    cell = points.withColumn("_c", F.floor(F.col(order)))
    cells = cell.groupBy(series, "_c").agg(F.count(F.lit(1)).alias("_k"))
    before = cells.withColumn("_b", F.sum("_k").over(Window.partitionBy(series).orderBy("_c")) - F.col("_k")).drop("_k")
    rank = cell.join(before, [series, "_c"]).withColumn("_i", F.col("_b") + F.row_number().over(Window.partitionBy(series, "_c").orderBy(order, "y")) - 1)
    at = rank.join(F.broadcast(n), series)  # a row a series
    # rank i is kept if it is the rounded place of some step
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    near = F.floor(F.col("_i") / step + F.lit(0.5))
    keep = (F.col("_n") <= most) | (F.floor(near * step + F.lit(0.5)) == F.col("_i"))
    return at.where(keep).select(*points.columns)


def progress_text(stage: str, done: int, total: int, run_id: str) -> str:
    return json.dumps({"run_id": run_id, "stage": stage, "done": done, "total": total}, sort_keys=True)


def progress_line(stage: Column, done: Column, total: Column, run_id: Column) -> Column:
    """The same of columns."""
    return F.to_json(F.struct(done.alias("done"), run_id.alias("run_id"), stage.alias("stage"), total.alias("total")))


def unknown_names(enabled: Column, known: list[str]) -> Column:
    """Names that a configuration enables and the registry doesn't know."""
    return F.array_sort(F.array_except(enabled, F.array(*map(F.lit, known))))


def drop_unsafe(artifacts: DataFrame, scanned: DataFrame) -> DataFrame:
    """Artifacts whose path wasn't scanned already."""
    return artifacts.join(scanned.select("path").distinct(), "path", "left_anti")
