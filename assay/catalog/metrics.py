from pyspark.sql import functions as F

from assay.catalog.selection import eval_rows
from assay.catalog.sql import EVAL, LINES, STEPS, wilson
from assay.operators import metrics as M
from assay.catalog.base import query
from assay.sources.corpora import line_corpus



def R(df, *cols, places=6):
    """df with some columns rounded: sums of doubles depend on their order."""
    return df.withColumns({c: F.round(c, places) for c in cols})


EV_STEPS = f"WITH {EVAL}{STEPS.format(rows='eval')}"
LI_STEPS = f"WITH {LINES}{STEPS.format(rows='li')}"
CONF = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn"


@query("confusion_counts", f"WITH {EVAL}, c AS (SELECT {CONF} FROM eval) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr FROM c")
def _(spark, sf):
    return R(M.confusion(eval_rows(spark, sf), 0.5), "precision", "recall", "f1", "fpr")


@query("wilson_interval", f"WITH {LINES}, c AS (SELECT year(timestamp) AS y, count(*) FILTER (label = 1 AND score >= 0.5) AS k, count(*) FILTER (label = 1) AS n FROM li GROUP BY y) SELECT y, k, n, round({wilson('k', 'n', 'lo')}, 6) AS lo, round({wilson('k', 'n', 'hi')}, 6) AS hi FROM c")
def _(spark, sf):
    c = line_corpus(spark, sf).groupBy(F.year("timestamp").cast("bigint").alias("y")).agg(F.count_if((F.col("label") == 1) & (F.col("score") >= 0.5)).alias("k"), F.count_if(F.col("label") == 1).alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return R(c.withColumn("lo", lo).withColumn("hi", hi), "lo", "hi")


@query("auroc_rank", f"{EV_STEPS} SELECT round(sum(p * (nn - fp + n / 2.0::DOUBLE)) / (max(np) * max(nn)), 6) AS auroc FROM c")
def _(spark, sf):
    return R(M.auroc(eval_rows(spark, sf)), "auroc")


@query("auroc_trapezoid", f"{LI_STEPS} SELECT round(sum(p * (nn - fp + n / 2.0::DOUBLE)) / (max(np) * max(nn)), 6) AS auroc FROM c")
def _(spark, sf):
    return R(M.auroc(line_corpus(spark, sf)), "auroc")


@query("average_precision", f"{EV_STEPS} SELECT round(sum(p / np * (tp / (tp + fp))), 6) AS average_precision FROM c")
def _(spark, sf):
    return R(M.average_precision(eval_rows(spark, sf)), "average_precision")


@query("roc_curve", f"{EV_STEPS} SELECT score AS threshold, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM c UNION ALL SELECT 'infinity'::DOUBLE, 0.0, 0.0")
def _(spark, sf):
    return R(M.roc_points(eval_rows(spark, sf)), "tpr", "fpr")


@query("pr_curve", f"{EV_STEPS} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM c")
def _(spark, sf):
    return R(M.pr_points(eval_rows(spark, sf)), "precision", "recall")


@query("tpr_at_fpr", f"{EV_STEPS} SELECT target, round(max(CASE WHEN fp / nn <= target THEN tp / np ELSE 0 END), 6) AS tpr FROM c, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) t(target) GROUP BY target")
def _(spark, sf):
    roc = M.roc_points(eval_rows(spark, sf))
    parts = [roc.where(F.col("fpr") <= M.dbl(t)).agg(M.dbl(t).alias("target"), F.round(F.max("tpr"), 6).alias("tpr")) for t in (0.001, 0.01, 0.05)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("threshold_for_fpr", f"{LI_STEPS} SELECT score AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM c WHERE fp / nn <= 0.01::DOUBLE ORDER BY score LIMIT 1")
def _(spark, sf):
    return R(M.threshold_for_fpr(line_corpus(spark, sf), 0.01), "fpr", "tpr")


@query("operating_points", f"{EV_STEPS}, pts AS (SELECT 'declared' AS point, 0.5::DOUBLE AS threshold UNION ALL SELECT 'fpr_1pct', (SELECT min(score) FROM c WHERE fp / nn <= 0.01::DOUBLE) UNION ALL SELECT 'fpr_5pct', (SELECT min(score) FROM c WHERE fp / nn <= 0.05::DOUBLE)) SELECT point, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp FROM pts, eval GROUP BY point, threshold")
def _(spark, sf):
    rows = eval_rows(spark, sf)
    at = lambda name, t: M.threshold_for_fpr(rows, t).select(F.lit(name).alias("point"), "threshold")
    points = spark.createDataFrame([("declared", 0.5)], "point string, threshold double").unionByName(at("fpr_1pct", 0.01)).unionByName(at("fpr_5pct", 0.05))
    hit = F.col("score") >= F.col("threshold")
    return rows.crossJoin(F.broadcast(points)).groupBy("point", "threshold").agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"))  # three points


@query("brier", f"WITH {LINES} SELECT round(avg((score - label) * (score - label)), 6) AS brier FROM li WHERE label >= 0")
def _(spark, sf):
    return R(M.brier(line_corpus(spark, sf)), "brier")


_BIN = "greatest(least(ceil(score * 15.0::DOUBLE) - 1, 14), 0)"


@query("ece", f"WITH {LINES}, b AS (SELECT {_BIN} AS bin, count(*) AS n, sum(score) AS s, sum(label) AS y FROM li WHERE label >= 0 GROUP BY bin) SELECT round(sum(abs(y - s)) / sum(n), 6) AS ece FROM b")
def _(spark, sf):
    return R(M.ece(line_corpus(spark, sf)), "ece")


@query("ece_bins", f"WITH {LINES} SELECT CAST({_BIN} AS INTEGER) AS bin, count(*) AS n, round(sum(score), 4) AS s, CAST(sum(label) AS BIGINT) AS y FROM li WHERE label >= 0 GROUP BY bin")
def _(spark, sf):
    return M.ece_bins(line_corpus(spark, sf)).withColumn("s", F.round("s", 4))


@query("score_hist", f"WITH {LINES}, h AS (SELECT label, CAST(least(floor(greatest(least(score, 1), 0) * 50.0::DOUBLE), 49) AS INTEGER) AS bin, count(*) AS n FROM li WHERE label >= 0 GROUP BY ALL) SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM h")
def _(spark, sf):
    return R(M.score_histogram(line_corpus(spark, sf)), "share")


_CAL = "b AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM li WHERE label = 0), a AS (SELECT max(n) AS n, max(score) FILTER (r >= floor(0.005::DOUBLE * n + 1e-9) + 1) AS above FROM b)"


@query("calibrate_threshold", f"WITH {LINES}, {_CAL} SELECT n, round(above, 9) AS threshold, (SELECT count(*) FILTER (b.score > a.above) / max(b.n) FROM b) AS achieved FROM a")
def _(spark, sf):
    return R(M.calibrated_threshold(line_corpus(spark, sf), 0.005), "threshold", places=9)


@query("attack_metrics", f"{EV_STEPS}, d AS (SELECT max(tp / np - fp / nn) AS best FROM c) SELECT round((SELECT best FROM d), 6) AS best_advantage, max(score) FILTER (tp / np - fp / nn = (SELECT best FROM d)) AS best_threshold, round(max(tp / np) FILTER (fp / nn <= 0.01::DOUBLE), 6) AS tpr_at_1pct, round((SELECT count(*) FILTER (score >= 0.5 AND label = 1) / count(*) FILTER (label = 1) - count(*) FILTER (score >= 0.5 AND label = 0) / count(*) FILTER (label = 0) FROM eval), 6) AS advantage, round(sum(p * (nn - fp + n / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn)), 6) AS auroc FROM c")
def _(spark, sf):
    return R(M.attack_metrics(eval_rows(spark, sf), 0.5), "best_advantage", "tpr_at_1pct", "advantage", "auroc")


@query("ci95_quantile", f"WITH {LINES} SELECT split, round(quantile_cont(score, 0.025), 6) AS lo, round(quantile_cont(score, 0.975), 6) AS hi FROM li GROUP BY split")
def _(spark, sf):
    return R(line_corpus(spark, sf).groupBy("split").agg(F.percentile("score", 0.025).alias("lo"), F.percentile("score", 0.975).alias("hi")), "lo", "hi")


@query("member_accuracy", f"WITH {EVAL} SELECT sha256 IN (SELECT sha256 FROM members) AS member, count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM ev WHERE label >= 0 GROUP BY member")
def _(spark, sf):
    from assay.sources.corpora import events_corpus, training_hashes

    ev = events_corpus(spark, sf).where("label >= 0")
    m = training_hashes(events_corpus(spark, sf)).withColumn("m", F.lit(True))
    right = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return R(ev.join(m, "sha256", "left").groupBy(F.col("m").isNotNull().alias("member")).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy")), "accuracy")


@query("fidelity", f"WITH {LINES} SELECT count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (score >= 0.45) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement, round(greatest(avg(CASE WHEN score >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN score < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS majority FROM li")
def _(spark, sf):
    hit = lambda t: (F.col("score") >= t).cast("double")
    a = line_corpus(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg((hit(0.5) == hit(0.45)).cast("double")).alias("agreement"), F.greatest(F.avg(hit(0.5)), F.avg(1 - hit(0.5))).alias("majority"))
    return R(a, "agreement", "majority")


@query("loss_hist", f"WITH {LINES}, x AS (SELECT split, log10(greatest(-CASE WHEN label = 1 THEN ln(greatest(score, 1e-300::DOUBLE)) ELSE ln(1 - least(score, 0.9999::DOUBLE)) END, 1e-8::DOUBLE)) AS l FROM li WHERE label >= 0), h AS (SELECT split, CAST(floor(least(greatest((l + 8) / 10 * 40, 0), 39)) AS INTEGER) AS bin, count(*) AS n FROM x GROUP BY ALL) SELECT split, bin, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM h")
def _(spark, sf):
    from pyspark.sql import Window

    d = M.dbl
    loss = -F.when(F.col("label") == 1, F.log(F.greatest("score", d(1e-300)))).otherwise(F.log(d(1) - F.least("score", d(0.9999))))
    x = line_corpus(spark, sf).where("label >= 0").select("split", F.log10(F.greatest(loss, d(1e-8))).alias("l"))
    h = x.groupBy("split", F.floor(F.least(F.greatest((F.col("l") + 8) / 10 * 40, d(0)), d(39))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return R(h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split"))), "share")
