"""From checks to module statuses to one verdict, for any number of runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READY, CONDITIONAL, COVERAGE, CAP = 80.0, 60.0, 0.75, 49.0
UNSCORED = ["file_safety", "dummy"]
RANK = {"ready": 0, "conditional": 1, "not_ready": 2, "blocked": 3}


def module_status(checks: DataFrame) -> DataFrame:
    """checks (run_id, module_id, gate, name, passed, score) to a row for each module: status, outcome, score.

    One failed check fails the gate (status fail for a hard gate, else warn); else one that couldn't be
    evaluated leaves it not evaluated (warn); the score is the weakest check's."""
    failed, unknown = F.bool_or(~F.col("passed")), F.bool_or(F.col("passed").isNull())
    agg = checks.groupBy("run_id", "module_id", "gate").agg(F.coalesce(failed, F.lit(False)).alias("failed"), unknown.alias("unknown"), F.min("score").alias("score"), F.count(F.lit(1)).alias("n_checks"))
    status = F.when(F.col("failed"), F.when(F.col("gate") == "hard", "fail").otherwise("warn")).when(F.col("unknown"), "warn").otherwise("pass")
    outcome = F.when(F.col("failed"), "failed").when(F.col("unknown"), "not_evaluated").otherwise("passed")
    return agg.select("run_id", "module_id", "gate", status.alias("status"), outcome.alias("outcome"), "score", "n_checks")


def verdicts(modules: DataFrame, weights: DataFrame, required: list[str] | None = None) -> DataFrame:
    """A row for each run: score (0 to 100, one place, rounded before the bands), coverage, blockers, verdict."""
    m = modules.join(F.broadcast(weights), "module_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))  # one row a module
    scored = ~F.col("module_id").isin(UNSCORED) & (F.col("weight") > 0)
    counted = scored & F.col("score").isNotNull() & ~F.isnan("score") & ~F.col("status").isin("skipped", "error")
    clipped = F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0))
    block = (F.col("status") == "error") | ((F.col("gate") == "hard") & F.col("outcome").isin("failed", "not_evaluated")) | ((F.col("module_id") == "file_safety") & (F.col("outcome") == "failed"))
    warned = (F.col("outcome") == "failed") & ~F.col("module_id").isin(UNSCORED)
    met = F.count_if(F.col("module_id").isin(required or []) & (F.col("outcome") == "passed"))
    a = m.groupBy("run_id").agg(
        F.sum(F.when(scored, F.col("weight")).otherwise(0.0)).alias("total"),
        F.sum(F.when(counted, F.col("weight")).otherwise(0.0)).alias("counted"),
        F.sum(F.when(counted, F.col("weight") * clipped).otherwise(0.0)).alias("sum"),
        F.count_if(block).alias("n_blockers"),
        F.count_if(warned).alias("n_warned"),
        (F.lit(len(required or [])) - met).alias("n_missing"),
    )
    raw = F.when(F.col("counted") > 0, F.floor(F.lit(1000.0) * F.col("sum") / F.col("counted") + F.lit(0.5)) / F.lit(10.0))
    a = a.withColumn("raw", raw).withColumn("coverage", F.when(F.col("total") > 0, F.col("counted") / F.col("total")).otherwise(0.0))
    ready = (F.col("raw") >= READY) & (F.col("n_warned") == 0) & (F.col("n_missing") == 0) & (F.col("coverage") >= COVERAGE)
    verdict = F.when(F.col("n_blockers") > 0, "blocked").when(F.col("raw").isNull(), "not_ready").when(ready, "ready").when(F.col("raw") >= CONDITIONAL, "conditional").otherwise("not_ready")
    score = F.when((F.col("n_blockers") > 0) & (F.col("raw") > CAP), F.lit(CAP)).otherwise(F.col("raw"))
    return a.select("run_id", score.alias("score"), "coverage", "n_blockers", verdict.alias("verdict"))


def exit_codes(verdict: DataFrame) -> DataFrame:
    code = F.when(F.col("verdict") == "ready", 0).when(F.col("verdict") == "conditional", 0).when(F.col("verdict") == "blocked", 2).otherwise(1)
    return verdict.withColumn("exit_code", code)


def best_run(verdict: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("verdict")]
    order = F.struct(rank, -F.coalesce("score", F.lit(-1.0)), -F.col("coverage"), F.col("run_id"))
    return verdict.agg(F.min_by("run_id", order).alias("run_id"))


def spec_problems(spec: Column, kinds: tuple[str, ...] = ("lightgbm", "xgboost", "onnx", "sklearn")) -> Column:
    """All that is wrong with a model's JSON specification, at once."""
    get = lambda k: F.get_json_object(spec, f"$.{k}")
    threshold = get("threshold").cast("double")
    wrong = [
        F.when(F.coalesce(F.trim(get("name")), F.lit("")) == "", "name: missing"),
        F.when(~F.coalesce(get("kind").isin(*kinds), F.lit(False)), "kind: unknown"),
        F.when(~F.coalesce(threshold.between(0, 1), F.lit(False)), "threshold: not in [0, 1]"),
    ]
    return F.array_compact(F.array(*wrong))
