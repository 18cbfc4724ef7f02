"""The modules of a gate run: a corpus and a policy in, graded checks and a verdict out.

Each module gives one row: its metrics, and `checks`, an array of the graded checks (name, op, threshold, value,
passed, score). Defaults are fixed values of the policy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import grading as G
from assay.functions.scalars import dbl, log_confidence
from assay.operators import metrics as M
from assay.operators import pairing as P
from assay.operators import screen
from assay.operators import selection as S
from assay.operators import trees as T
from assay.operators import triggers as TR
from assay.operators import windows as W
from assay.plans.verdict import module_status, verdicts

# The modules' codes, gates and what they need.
CODES = {"file_safety": "M0", "performance": "M1", "drift": "M2", "membership": "M4", "backdoor": "M5", "extraction": "M6", "explanation": "M7"}
REQUIRES = {"performance": ["feature_space"], "drift": ["feature_space", "timestamps"], "membership": ["feature_space", "training_hashes"], "extraction": ["feature_space"], "explanation": ["feature_space"]}
REQUIRES_ANY = {"backdoor": ["tree_access", "triggers"]}


def eval_rows(corpus: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Labelled rows of the eval role that are no members, once each hash and class."""
    return S.dedup_first(S.select_rows(corpus, role="eval", exclude=members), "label", "sha256")


def eval_counts(corpus: DataFrame, members: DataFrame) -> DataFrame:
    """One row: of each class the members left out, and the repeats dropped among the others."""
    rows = S.select_rows(corpus, role="eval").select("sha256", "label")
    known = rows.join(members.select("sha256").distinct().withColumn("member", F.lit(True)), "sha256", "left")
    per = known.groupBy("label", "sha256").agg(F.count(F.lit(1)).alias("n"), F.bool_or("member").alias("member"))
    of = lambda label, c: F.coalesce(F.sum(F.when(F.col("label") == label, c)), F.lit(0))
    gone, again = F.when(F.col("member"), F.col("n")).otherwise(0), F.when(F.col("member").isNull(), F.col("n") - 1).otherwise(0)
    return per.agg(of(0, gone).alias("excluded_benign"), of(1, gone).alias("excluded_malicious"), of(0, again).alias("repeats_benign"), of(1, again).alias("repeats_malicious"))


def m1_performance(corpus: DataFrame, members: DataFrame, threshold: float, max_fpr: float = 0.01, min_detection: float = 0.95, bins: int = 15) -> DataFrame:
    perf = M.performance(eval_rows(corpus, members), threshold, max_fpr, bins).crossJoin(eval_counts(corpus, members))  # one row each
    return perf.withColumn("checks", F.array(G.fpr_check(F.col("fpr"), max_fpr), G.detection_check(F.col("detection_rate"), min_detection)))


def m1_challenge(corpus: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Detection rate on the challenge's malicious rows that are no members, once each."""
    rows = S.dedup_first(S.select_rows(corpus, role="challenge", label=1, exclude=members), "sha256")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= dbl(threshold)).alias("detected"))
    lo, hi = M.wilson(F.col("detected"), F.col("n"))
    return got.select("n", "detected", M.ratio(F.col("detected"), F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def threshold_bootstrap(calibration: DataFrame, rows: DataFrame, target: float, max_fpr: float, min_detection: float, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(replicate, threshold, fpr, detection_rate) of `resamples` replicates: the benign calibration scores are drawn again
    and the threshold fitted to them, then the eval rows are drawn again.

    Nothing is drawn row by row. The (k+1)-th largest of n draws with replacement is the empirical quantile at a
    Beta(n-k, k+1) variate, and the number of n drawn rows at or above a threshold is binomial. So a replicate costs three random
    numbers, whatever the tables' sizes, and a place among the distinct scores, found through equal ranges of ranks.
    """
    spark = calibration.sparkSession
    rng = np.random.default_rng(seed)
    n = calibration.where("label = 0").count()
    if not n or resamples < 1:
        raise ValueError("a bootstrap needs calibration scores and at least one replicate")
    k = int(np.floor(target * n + 1e-9))
    # from the top: the drawn score is that of the row of this rank (1: the largest)
    rank = np.zeros(resamples, np.int64) if k >= n else np.clip(np.ceil((1 - rng.beta(n - k, k + 1, resamples)) * n).astype(np.int64), 1, n)
    width = max(1, n // resamples)
    draws = spark.createDataFrame([(i, int(r), int(r) // width, float(a), float(b)) for i, (r, a, b) in enumerate(zip(rank, rng.random(resamples), rng.random(resamples), strict=True))], "replicate int, rank bigint, cell bigint, u_fpr double, u_det double")
    steps = M.score_steps(calibration.where("label = 0"))
    cells = steps.select("score", "fp", "n", F.explode(F.sequence(F.floor((F.col("fp") - F.col("n") + 1) / width), F.floor(F.col("fp") / width))).alias("cell"))
    at = cells.join(F.broadcast(draws), "cell").where("rank > fp - n and rank <= fp").select("replicate", F.when(F.col("score") >= 0, F.when(F.col("score") == 0, dbl(5e-324)).otherwise(M.next_up(F.col("score")))).otherwise(dbl(0)).alias("threshold"))
    fitted = draws.join(at, "replicate", "left").select("replicate", F.coalesce("threshold", dbl(0)).alias("threshold"), "u_fpr", "u_det")
    fitted = fitted.withColumn("threshold", F.least("threshold", M.next_up(dbl(1))))
    return binomial_rates(fitted, rows, max_fpr, min_detection)


def binomial_rates(fitted: DataFrame, rows: DataFrame, max_fpr: float, min_detection: float) -> DataFrame:
    """Rates of eval rows drawn again at each replicate's threshold (a row a replicate), and whether the gate's conditions hold."""
    marks = fitted.select("threshold").distinct()
    # for each threshold the eval rows at or above it: running counts, carried down to the thresholds
    steps = M.score_steps(rows).select("score", "tp", "fp", F.lit(1).alias("side")).unionByName(marks.select(F.col("threshold").alias("score"), F.lit(None).cast("bigint").alias("tp"), F.lit(None).cast("bigint").alias("fp"), F.lit(0).alias("side")))
    edges = marks.agg(F.sort_array(F.collect_set("threshold")).alias("marks"))  # one for each replicate at most
    steps = steps.crossJoin(F.broadcast(edges)).withColumn("cell", F.size(F.filter("marks", lambda t: t <= F.col("score"))))
    per = steps.where("side = 1").groupBy("cell").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    w = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    reach = spark_range_cells(edges).join(per, "cell", "left").select("cell", "threshold", F.coalesce(F.max("tp").over(w), F.lit(0)).alias("tp"), F.coalesce(F.max("fp").over(w), F.lit(0)).alias("fp"))
    total = M.totals(rows)
    at = fitted.join(reach.drop("cell"), "threshold").crossJoin(F.broadcast(total))
    schema = "replicate int, threshold double, fpr double, detection_rate double, fpr_ok boolean, detection_ok boolean"

    def draw(batches):
        import pandas as pd

        for pdf in batches:
            out = {"replicate": pdf.replicate, "threshold": pdf.threshold}
            for name, hit, whole, salt in (("fpr", "fp", "nn", 1), ("detection_rate", "tp", "np", 2)):
                size = int(pdf[whole].iloc[0]) if len(pdf) else 0
                drawn = [np.random.default_rng([salt, int(u * 2**53)]).binomial(size, h / size) / size if size else np.nan for u, h in zip(pdf["u_fpr" if salt == 1 else "u_det"], pdf[hit], strict=True)]
                out[name] = drawn
            got = pd.DataFrame(out)
            got["fpr_ok"], got["detection_ok"] = got.fpr <= max_fpr, got.detection_rate >= min_detection
            yield got

    return at.mapInPandas(draw, schema)


def spark_range_cells(edges: DataFrame) -> DataFrame:
    """(cell, threshold): cell i holds the scores from the i-th smallest threshold up to the next."""
    return edges.select(F.posexplode("marks").alias("cell", "threshold")).withColumn("cell", F.col("cell") + 1)


def m1_threshold_noise(calibration: DataFrame, rows: DataFrame, target: float, max_fpr: float = 0.01, min_detection: float = 0.95, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """One row: 95 % intervals over the replicates, and the share of them in which each condition of the gate holds."""
    b = threshold_bootstrap(calibration, rows, target, max_fpr, min_detection, resamples, seed)
    ci = [F.percentile(c, q).alias(f"{c}_{side}") for c in ("threshold", "fpr", "detection_rate") for q, side in ((0.025, "lo"), (0.975, "hi"))]
    share = lambda c: F.avg(c.cast("double"))
    return b.agg(F.count(F.lit(1)).alias("resamples"), *ci, share(F.col("fpr_ok")).alias("fpr_pass"), share(F.col("detection_ok")).alias("detection_pass"), share(F.col("fpr_ok") & F.col("detection_ok")).alias("both_pass"))


def m2_drift(corpus: DataFrame, members: DataFrame | None, cutoff: str, threshold: float, step: str = "month", least: int = 200, least_benign: int = 100, most: int = 36, min_aut: float = 0.7, max_fpr: float = 0.01) -> DataFrame:
    """Windows after the cut-off, without members, the first `most` of them; AUT(F1) by size is graded, the fpr budget is not."""
    rows = S.select_rows(corpus, after=cutoff, exclude=members)
    windows = W.window_rows(rows, cutoff, step, threshold, least, least_benign).where(F.col("k") <= most)
    used = windows.where("status = 'used'")
    aut, move, budget, ends = W.area_under_time(used), W.change(used).drop("max_fpr"), W.fpr_budget(used, max_fpr, least_benign), W.max_window_fpr(windows)
    n = used.agg(F.count(F.lit(1)).alias("n_windows"))
    got = n.crossJoin(aut).crossJoin(move).crossJoin(budget).crossJoin(ends)  # one row each
    check = G.graded_check("aut_f1_weighted", F.col("aut_weighted"), ">=", min_aut, min(1.0, min_aut + 0.2), max(0.0, min_aut - 0.3))
    return got.withColumn("checks", F.array(check, G.gate_check("window_fpr_within_budget", F.col("worst_lower_bound"), "<=", max_fpr)))


def member_accuracy(pairs: DataFrame, threshold: float) -> DataFrame:
    right = (F.col("score") >= dbl(threshold)) == (F.col("label") == 1)
    return pairs.groupBy("member").agg(F.avg(right.cast("double")).alias("accuracy"))


def pair_rows(corpus: DataFrame, pairs: DataFrame, test_share: float, seed: int) -> DataFrame:
    """Both rows of each pair with label, score, member, test, and the loss attack's score: log P(true label); staged, as are the
    pairs, which are read twice: a fit reads them in many passes, each of which would pair the corpus anew."""
    from assay.sources.staging import staged

    split = S.split_pairs(staged(pairs, "pairs"), test_share, seed)
    sides = split.select("pair", "test", F.explode(F.array(F.struct(F.col("member_row").alias("row_id"), F.lit(1).alias("member")), F.struct(F.col("other_row").alias("row_id"), F.lit(0).alias("member")))).alias("s"))
    own = corpus.select("row_id", "label", "score")
    return staged(sides.select("pair", "test", "s.row_id", "s.member").join(own, "row_id").withColumn("confidence", log_confidence(F.col("score"), F.col("label"))), "pair-rows")


def m4_membership(corpus: DataFrame, manifest: DataFrame, threshold: float, seed: int = 0, max_advantage: float = 0.1, least: int = 200, most: int | None = 5000, test_share: float = 0.5, models: tuple[str, ...] = ()) -> DataFrame:
    """The worst advantage of the attacks on held-out pairs: loss with the best threshold of the other half, and those of `models`."""
    pairs, design = P.member_sample(corpus, manifest, seed, least, most)
    rows = pair_rows(corpus, pairs, test_share, seed)
    as_scores = lambda df, c: df.select("row_id", F.col("member").alias("label"), F.col(c).alias("score"))
    cut = M.attack_metrics(as_scores(rows.where("not test"), "confidence"), 0.0).first().best_threshold
    found = M.attack_metrics(as_scores(rows.where("test"), "confidence"), cut).withColumn("attack", F.lit("loss_threshold"))
    for kind in models:
        found = found.unionByName(M.attack_metrics(attack_scores(rows, kind, seed), float(np.nextafter(0.5, 1))).withColumn("attack", F.lit(f"model_{kind}")))
    worst = found.agg(F.max_by(F.struct("attack", "advantage", "best_advantage", "auroc", "tpr_at_1pct"), "advantage").alias("w"), F.max("advantage").alias("value")).select("w.*")
    acc = member_accuracy(rows, threshold).agg(F.max(F.when(F.col("member") == 1, F.col("accuracy"))).alias("member_accuracy"), F.max(F.when(F.col("member") == 0, F.col("accuracy"))).alias("other_accuracy"))
    n = rows.agg(F.countDistinct("pair").alias("n_pairs"))
    got = worst.crossJoin(acc).crossJoin(n).withColumn("design", F.lit(design)).withColumn("upper_bound", F.lit(design == "nearest_time"))  # one row each
    return got.withColumn("checks", F.array(G.gate_check("membership_advantage", F.col("advantage"), "<=", max_advantage, *G.advantage_anchors(dbl(max_advantage)))))


def attack_scores(rows: DataFrame, kind: str, seed: int) -> DataFrame:
    """(row_id, label: member, score: its probability) of the held-out pairs by a model (rf or gb) of score and label, fitted on the others."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    p = F.least(F.greatest("score", dbl(0)), dbl(1))
    data = VectorAssembler(inputCols=["q", "p", "y"], outputCol="x").transform(rows.select("row_id", "test", F.col("member").cast("double").alias("m"), (dbl(1) - p).alias("q"), p.alias("p"), F.col("label").cast("double").alias("y")))
    model = {"rf": RandomForestClassifier(featuresCol="x", labelCol="m", seed=seed, numTrees=100), "gb": GBTClassifier(featuresCol="x", labelCol="m", seed=seed, maxIter=50)}[kind]
    out = model.fit(data.where("not test")).transform(data.where("test"))
    return out.select("row_id", F.col("m").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


def m5_backdoor(nodes: DataFrame, rows: DataFrame | None = None, triggers: dict[str, dict[int, float]] | None = None, threshold: float = 0.5, least: float = 0.5, max_drop: float = 0.2, quantile: float = 0.5) -> DataFrame:
    """Static scan of the rules, and the largest loss of detections that a trigger causes on rows (vec_id, embedding)."""
    walk = screen.covers(nodes)
    features = screen.feature_suspicion(screen.gate_statistics(walk), quantile)
    rules = screen.rule_suspicion(walk, screen.path_states(walk, features))
    got = rules.agg(F.count_if(F.col("suspicion") >= dbl(least)).alias("n_flagged"), F.coalesce(F.max("suspicion"), dbl(0)).alias("top_suspicion"))
    scan = F.struct(F.lit("suspicious_rules").alias("name"), F.lit("==").alias("op"), dbl(0).alias("threshold"), F.col("n_flagged").cast("double").alias("value"), (F.col("n_flagged") == 0).alias("passed"), G.scan_check_score(F.col("n_flagged"), F.col("top_suspicion"), least).alias("score"))
    if not triggers:
        return got.withColumn("checks", F.array(scan))
    worst = trigger_results(rows, nodes, triggers, threshold).agg(F.max_by(F.struct("trigger", "drop"), F.struct("drop", "trigger")).alias("w")).select(F.col("w.trigger").alias("worst_trigger"), F.col("w.drop").alias("max_trigger_drop"))
    check = G.graded_check("max_trigger_drop", F.col("max_trigger_drop"), "<=", max_drop, 0.02, 0.8)
    return got.crossJoin(worst).withColumn("checks", F.array(scan, check))  # one row each


def trigger_results(rows: DataFrame, nodes: DataFrame, triggers: dict[str, dict[int, float]], threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(trigger, n, before, after, drop, evasion, mean_shift, n_outside): what stamping each trigger does to detected rows.

    n_outside: the trigger's features with a value outside the range of the detected rows."""
    from assay.functions.scalars import logistic

    def scored(df: DataFrame) -> DataFrame:
        return T.score_rows(df, nodes, id_col, vec_col).select(id_col, logistic(F.col("raw")).alias("score"))

    before = scored(rows).withColumnRenamed("score", "before")
    base = rows.join(before, id_col)
    hits = base.where(F.col("before") >= dbl(threshold))
    out = None
    for name, trigger in sorted(triggers.items()):
        after = scored(hits.select(id_col, TR.stamp(F.col(vec_col), trigger).alias(vec_col))).withColumnRenamed("score", "after")
        got = base.select(id_col, "before", *[F.col(vec_col)[k].cast("double").alias(f"f{k}") for k in trigger]).join(after, id_col, "left")
        outside = F.lit(0)
        for k, v in trigger.items():
            own = F.when(F.col("after").isNotNull(), F.col(f"f{k}"))
            outside = outside + F.when((F.min(own) > dbl(v)) | (F.max(own) < dbl(v)), 1).otherwise(0)
        row = got.agg(F.count(F.lit(1)).alias("n"), F.count("after").alias("before"), F.count_if(F.col("after") >= dbl(threshold)).alias("after"), F.avg(F.when(F.col("after").isNotNull(), F.col("before") - F.col("after"))).alias("mean_shift"), outside.alias("n_outside")).withColumn("trigger", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("drop", M.ratio(F.col("before") - F.col("after"), F.col("n"))).withColumn("evasion", M.ratio(F.col("before") - F.col("after"), F.col("before")))


def budget_list(budgets: list[int], gated: int) -> list[int]:
    """Distinct query budgets in order, the gated one among them."""
    out = sorted({*map(int, budgets), int(gated)})
    if out[0] < 1:
        raise ValueError(f"budgets must be positive, not {out}")
    return out


def budgets_of(budgets: Column, gated: Column) -> Column:
    """The same of columns."""
    return F.array_sort(F.array_distinct(F.concat(budgets.cast("array<bigint>"), F.array(gated.cast("bigint")))))


def surrogate_fit(labelled: DataFrame, kind: str, seed: int = 0):
    """A model of (x vector, y 0 or 1) rows: rf, gb or lr; a constant where only one class occurs."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    seen = [r.y for r in labelled.select("y").distinct().limit(2).collect()]
    if len(seen) < 2:
        return lambda df: df.withColumn("guess", F.lit(float(seen[0]) if seen else 0.0))
    made = {"rf": lambda: RandomForestClassifier(featuresCol="x", labelCol="y", seed=seed, numTrees=50), "gb": lambda: GBTClassifier(featuresCol="x", labelCol="y", seed=seed, maxIter=20), "lr": lambda: LogisticRegression(featuresCol="x", labelCol="y", standardization=True)}
    model = made[kind]().fit(labelled)
    return lambda df: model.transform(df).withColumnRenamed("prediction", "guess")


def m6_extraction(rows: DataFrame, budgets: list[int], gated: int, kind: str = "lr", n_eval: int = 5000, seed: int = 0, max_fidelity: float = 0.95) -> DataFrame:
    """rows (row_id, x vector, verdict 0 or 1, label): a surrogate for each budget, fitted on the model's verdicts for the first
    rows in hash order of the query pool, and its agreement with the verdicts on held-out rows."""
    from assay.operators.ranks import hash_ranked
    from assay.sources.staging import staged

    ranked = staged(hash_ranked(rows, [], seed, "place"), "extraction-rows")
    held, pool = ranked.where(F.col("place") <= n_eval), ranked.where(F.col("place") > n_eval)
    n_pool = pool.count()
    sizes = sorted({min(b, n_pool) for b in budget_list(budgets, gated)})
    out = None
    for b in sizes:
        fitted = surrogate_fit(pool.where(F.col("place") <= n_eval + b).select("x", F.col("verdict").cast("double").alias("y")), kind, seed)
        agree = F.avg((F.col("guess") == F.col("verdict")).cast("double"))
        right = F.avg(F.when(F.col("label") >= 0, (F.col("guess") == F.col("label")).cast("double")))
        row = fitted(held).agg(agree.alias("fidelity"), right.alias("accuracy")).withColumn("budget", F.lit(b))
        out = row if out is None else out.unionByName(row)
    table = staged(out, "extraction-budgets")
    base = held.agg(F.greatest(F.avg("verdict"), dbl(1) - F.avg("verdict")).alias("majority"), F.avg(F.when(F.col("label") >= 0, (F.col("verdict") == F.col("label")).cast("double"))).alias("model_accuracy"))
    at = table.agg(F.max(F.when(F.col("budget") == min(gated, n_pool), F.col("fidelity"))).alias("fidelity"), F.max("fidelity").alias("max_fidelity"), F.min(F.when(F.col("fidelity") > dbl(max_fidelity), F.col("budget"))).alias("queries_to_exceed")).crossJoin(base)  # one row each
    # fewer queries than asked for can prove a failure, not a pass
    value = F.col("fidelity") if gated <= n_pool else F.when(F.col("fidelity") > dbl(max_fidelity), F.col("fidelity"))
    return at.withColumn("checks", F.array(G.gate_check("surrogate_fidelity", value, "<=", max_fidelity, *G.fidelity_anchors(dbl(max_fidelity)))))


WEIGHTS = {"controllable": 1.0, "append_only": 0.75}


def controllable_share(shares: DataFrame, levels: DataFrame) -> DataFrame:
    """Share of attribution on features that an attacker can set (or only append to, at .75)."""
    w = F.when(F.col("level") == "controllable", dbl(WEIGHTS["controllable"])).when(F.col("level") == "append_only", dbl(WEIGHTS["append_only"])).otherwise(dbl(0))
    return shares.join(F.broadcast(levels), "feature").agg(F.sum(w * F.col("share")).alias("controllable_share"))  # a row a feature


def m7_explanation(attribution: DataFrame, levels: DataFrame, top: int = 20, max_controllable: float = 0.5, max_top: float = 0.3) -> DataFrame:
    """attribution (feature, weight): how it concentrates, and how much of it an attacker controls."""
    s = T.shares(attribution, "weight")
    got = T.concentration(s, top).crossJoin(controllable_share(s, levels)).crossJoin(s.agg(F.max_by("feature", F.struct("share", (-F.col("feature")).alias("f"))).alias("top_feature")))  # one row each
    checks = [G.graded_check("controllable_share", F.col("controllable_share"), "<=", max_controllable, max_controllable / 2, min(1.0, max_controllable + 0.4)), G.graded_check("top_feature_share", F.col("top_1"), "<=", max_top, max_top / 3, min(1.0, max_top + 0.5))]
    return got.withColumn("checks", F.array(*checks))


def check_rows(results: dict[str, tuple[str, DataFrame]], run_id: int = 0) -> DataFrame:
    """(run_id, module_id, gate, name, passed, score) of modules given as id: (gate, result)."""
    out = None
    for module, (gate, df) in results.items():
        rows = df.select(F.lit(run_id).cast("bigint").alias("run_id"), F.lit(module).alias("module_id"), F.lit(gate).alias("gate"), F.explode("checks").alias("c")).select("run_id", "module_id", "gate", "c.name", "c.passed", "c.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def gate_run(results: dict[str, tuple[str, DataFrame]], weights: dict[str, float], required: list[str] | None = None, run_id: int = 0) -> DataFrame:
    """Module results to one verdict."""
    checks = check_rows(results, run_id)
    table = checks.sparkSession.createDataFrame(sorted(weights.items()), "module_id string, weight double")
    # a check without a score doesn't move the module's
    return verdicts(module_status(checks), table, required)


def capabilities(given: dict[str, Column]) -> Column:
    """Names of what a run provides, for those whose column is true."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in sorted(given.items())]))


def unmet_requirements(module: Column, caps: Column) -> Column:
    """What a module needs and caps lacks: all of REQUIRES, and one of REQUIRES_ANY (all are named if none is there)."""
    pick = lambda table: F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[module], F.array().cast("array<string>"))
    every, some = pick(REQUIRES), pick(REQUIRES_ANY)
    return F.concat(F.array_except(every, caps), F.when((F.size(some) > 0) & ~F.arrays_overlap(some, caps), some).otherwise(F.array().cast("array<string>")))


def skip_reason(missing: Column) -> Column:
    return F.when(F.size(missing) > 0, F.concat(F.lit("needs "), F.array_join(F.transform(missing, lambda x: F.replace(x, F.lit("_"), F.lit(" "))), " and ")))


def resolve_modules(names: list[str]) -> list[str]:
    """Ids for ids or codes in any case, also several in one string; in order, without repeats."""
    by_code = {code.lower(): module for module, code in CODES.items()}
    out: list[str] = []
    for name in [x.strip().lower() for part in names for x in part.split(",")]:
        module = by_code.get(name, name)
        if name and module not in CODES:
            raise ValueError(f"no module {name!r}")
        if name and module not in out:
            out.append(module)
    return out


def resolved(names: Column) -> Column:
    """The same of a column of names with commas."""
    by_code = F.create_map(*[F.lit(x) for module, code in CODES.items() for pair in ((code.lower(), module), (module, module)) for x in pair])
    known = lambda x: F.coalesce(F.try_element_at(by_code, x), F.raise_error(F.concat(F.lit("no module "), x)).cast("string"))
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(names, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""), known))


def plan_modules(registry: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """registry (module_id, enabled) with plan: run, deselected or disabled; modules asked for by name run if disabled too."""
    asked, out = resolve_modules(only or []), resolve_modules(skip or [])
    named = F.col("module_id").isin(asked)
    plan = F.when(F.col("module_id").isin(out), "deselected").when(F.lit(bool(asked)) & ~named, "deselected").when(named | F.col("enabled"), "run").otherwise("disabled")
    return registry.withColumn("plan", plan)


def validated_scores(rows: DataFrame, col: str = "score", slack: float = 1e-9) -> DataFrame:
    """rows with a model's scores clipped to [0, 1]; null, not finite or further outside than the slack raises."""
    s = F.col(col).cast("double")
    fine = F.coalesce(~F.isnan(s) & (s >= dbl(-slack)) & (s <= dbl(1 + slack)), F.lit(False))
    return rows.withColumn(col, F.when(fine, F.least(F.greatest(s, dbl(0)), dbl(1))).otherwise(F.raise_error(F.lit("scores must lie in [0, 1]"))))


def validated_labels(rows: DataFrame, col: str = "pred") -> DataFrame:
    fine = F.coalesce(F.col(col).isin(0, 1), F.lit(False))
    return rows.withColumn(col, F.when(fine, F.col(col)).otherwise(F.raise_error(F.lit("labels must be 0 or 1"))))


def parse_triggers(items: list[dict], names: dict[str, int], width: int) -> dict[str, dict[int, float]]:
    """Trigger hypotheses ({name, features: {feature name or index: value}}) by name, features as indices; anything else raises,
    with the known names nearest to one that isn't."""
    import difflib

    out: dict[str, dict[int, float]] = {}
    for item in items:
        name, features = item.get("name"), item.get("features")
        if not name or name in out or not isinstance(features, dict) or not features:
            raise ValueError(f"a trigger needs a name of its own and features: {item!r}")
        own = {}
        for key, value in features.items():
            at = names.get(str(key), int(key) if str(key).isdigit() else -1)
            if not 0 <= at < width:
                raise ValueError(f"trigger {name}: no feature {key!r}; near: {difflib.get_close_matches(str(key), names, 3)}")
            own[at] = G.number_param(value, f"{name}.{key}", -float("inf"), float("inf"))
        out[name] = own
    return out


def trigger_table(lines: DataFrame, names: dict[str, int], width: int) -> DataFrame:
    """(name, feature, value) of hypotheses as JSON lines (value); one without a name or features, or with a feature that isn't known, raises."""
    r = lines.select("value", F.from_json("value", "name string, features map<string,double>").alias("r"))
    whole = F.coalesce((F.col("r.name") != "") & (F.size("r.features") > 0), F.lit(False))
    r = r.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("a trigger needs a name and features: "), "value")).cast("boolean")))
    known = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    rows = r.select(F.col("r.name").alias("name"), F.explode("r.features").alias("key", "value"))
    at = F.coalesce(F.try_element_at(known, F.col("key")).cast("bigint"), F.col("key").try_cast("bigint"))
    inside = F.coalesce(at.between(0, width - 1), F.lit(False))
    return rows.select("name", F.when(inside, at).otherwise(F.raise_error(F.concat(F.lit("no feature "), "key")).cast("bigint")).alias("feature"), "value")


def adapter_checks(score, rows: DataFrame, id_col: str) -> DataFrame:
    """(name, passed) of what score(rows) -> (id, score) must keep: finite scores in [0, 1], the same twice, the same for a part of
    the rows as among all, and fewer rows flagged at a higher threshold."""
    whole, again, part = score(rows), score(rows), score(rows.where(F.pmod(F.xxhash64(id_col), F.lit(3)) == 0))
    equal = lambda a, b: a.join(b.withColumnRenamed("score", "other"), id_col).agg(F.coalesce(F.bool_and(F.col("score") == F.col("other")), F.lit(True)).alias("passed"))
    s = F.col("score")
    named = lambda df, name: df.select(F.lit(name).alias("name"), "passed")
    finite = whole.agg(F.bool_and(s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s <= 1)).alias("passed"))
    monotone = whole.agg((F.count_if(s >= 0.3) >= F.count_if(s >= 0.7)).alias("passed"))
    out = named(finite, "finite").unionByName(named(equal(whole, again), "deterministic")).unionByName(named(equal(part, whole), "batch_independent"))
    return out.unionByName(named(monotone, "monotone_threshold"))
