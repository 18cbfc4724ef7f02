"""Metrics of scored binary classifiers, as aggregations over (score, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054
CELLS = 256


def dbl(x) -> Column:
    return F.lit(float(x))


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    """a / b in doubles; `otherwise` (default null) where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(otherwise).cast("double"))


def confusion(rows: DataFrame, threshold: float, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (0 where undefined) and fpr (null without benign rows)."""
    hit, mal = F.col("score") >= dbl(threshold), F.col("label") == 1
    out = rows.where("label >= 0").groupBy(*by).agg(F.count_if(hit & mal).alias("tp"), F.count_if(hit & ~mal).alias("fp"), F.count_if(~hit & mal).alias("fn"), F.count_if(~hit & ~mal).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0), "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0), "fpr": ratio(fp, fp + tn)})


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of k of n; null at n = 0; the ends are exact at k = 0 and k = n."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, dbl(Z95 * Z95)
    below = dbl(1) + z2 / n
    centre = (p + z2 / (dbl(2) * n)) / below
    half = dbl(Z95) * F.sqrt(F.greatest(p * (dbl(1) - p) / n + z2 / (dbl(4) * n * n), dbl(0))) / below
    lo = F.when(n > 0, F.when(k == 0, dbl(0)).otherwise(F.greatest(dbl(0), centre - half)))
    hi = F.when(n > 0, F.when(k == n, dbl(1)).otherwise(F.least(dbl(1), centre + half)))
    return lo, hi


def outline(rows: DataFrame) -> DataFrame:
    """One row, in one pass and without a shuffle of rows: approximate quantiles of the labelled rows' scores (edges) and class totals (np, nn).

    The edges only deal out work, so they are those of every sixteenth score by its hash: a sketch is dear for each row."""
    mal = F.col("label") == 1
    some = F.when(F.pmod(F.xxhash64("score"), F.lit(16)) == 0, F.col("score"))
    edges = F.percentile_approx(some, F.array(*[dbl(k / CELLS) for k in range(1, CELLS)]), 4 * CELLS)
    return rows.where("label >= 0").agg(edges.alias("edges"), F.count_if(mal).alias("np"), F.count_if(F.col("label") == 0).alias("nn"))


def score_steps(rows: DataFrame, *by: str) -> DataFrame:
    """(by, score, p, n, tp, fp): for each distinct score the malicious and benign rows with it, and with it or more; without
    groups the class totals (np, nn) too.

    A running sum over all scores without one task for all: the scores are cut at CELLS approximate
    quantiles (so that a pile of scores at one end is spread too), the sums of the cells above come from a
    table of CELLS rows a group, the rest from windows within a cell.
    """
    whole = [] if by else ["np", "nn"]
    steps = rows.where("label >= 0").groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    steps = steps.crossJoin(F.broadcast(outline(rows)))  # one row
    steps = steps.withColumn("cell", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("score"))), F.lit(0))).drop("edges")
    above = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = steps.groupBy(*by, "cell").agg(F.sum("p").alias("cp"), F.sum("n").alias("cn"))  # at most CELLS rows a group
    cells = cells.select(*by, "cell", F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("n0"))
    own = Window.partitionBy(*by, "cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(F.broadcast(cells), [*by, "cell"]).select(*by, "score", "p", "n", (F.col("p0") + F.sum("p").over(own)).alias("tp"), (F.col("n0") + F.sum("n").over(own)).alias("fp"), *whole)


def totals(rows: DataFrame) -> DataFrame:
    return rows.where("label >= 0").agg(F.count_if(F.col("label") == 1).alias("np"), F.count_if(F.col("label") == 0).alias("nn"))


def roc_points(rows: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score; the point of no detections has threshold infinity."""
    at = score_steps(rows)
    points = at.select(F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("np")).alias("tpr"), ratio(F.col("fp"), F.col("nn")).alias("fpr"))
    start = totals(rows).select(dbl("inf").alias("threshold"), F.when(F.col("np") > 0, dbl(0)).alias("tpr"), F.when(F.col("nn") > 0, dbl(0)).alias("fpr"))
    return points.unionByName(start)


def pr_points(rows: DataFrame) -> DataFrame:
    at = score_steps(rows)
    return at.select(F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("np")).alias("recall"))


def auroc(rows: DataFrame, *by: str) -> DataFrame:
    """Mann-Whitney AUROC with ties averaged: pairs won by each score plus half the pairs that tie. Null without both classes."""
    at = score_steps(rows, *by)
    # pairs won by a score: its malicious rows over the benign rows below it; all benign rows are the largest fp
    sums = at.groupBy(*by).agg(F.sum(F.col("p").cast("double") * (F.col("n") / dbl(2) - F.col("fp"))).alias("won"), F.max("tp").alias("np"), F.max("fp").alias("nn"))
    won = F.col("won") + F.col("np").cast("double") * F.col("nn")
    return sums.select(*by, ratio(won, F.col("np").cast("double") * F.col("nn").cast("double")).alias("auroc"))


def average_precision(rows: DataFrame) -> DataFrame:
    at = score_steps(rows)
    return at.agg(F.sum(ratio(F.col("p"), F.col("np")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("average_precision"))


def threshold_for_fpr(rows: DataFrame, target: float) -> DataFrame:
    """The lowest threshold whose false-positive rate stays within target, with both rates there; null
    threshold when only the point of no detections does."""
    ok = roc_points(rows).where(F.col("fpr") <= dbl(target))
    best = ok.agg(F.min_by(F.struct("threshold", "fpr", "tpr"), "threshold").alias("b"))
    return best.select(F.when(F.col("b.threshold") < dbl("inf"), F.col("b.threshold")).alias("threshold"), F.col("b.fpr").alias("fpr"), F.col("b.tpr").alias("tpr"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.where("label >= 0").agg(F.avg(F.pow(F.col("score") - F.col("label"), dbl(2))).alias("brier"))


def ece_bins(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width bins, each without its left edge (the first with it)."""
    k = F.greatest(F.least(F.ceil(F.col("score") * dbl(bins)) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")
    return rows.where("label >= 0").groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"))


def ece(rows: DataFrame, bins: int = 15) -> DataFrame:
    return ece_bins(rows, bins).agg((F.sum(F.abs(F.col("y") - F.col("s"))) / F.sum("n")).alias("ece"))


def score_histogram(rows: DataFrame, bins: int = 50) -> DataFrame:
    """Share of each class in left-closed bins; the last bin is closed."""
    k = F.least(F.floor(F.greatest(F.least("score", dbl(1)), dbl(0)) * dbl(bins)), F.lit(bins - 1)).cast("int")
    found = rows.where("label >= 0").groupBy("label", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def next_up(x: Column) -> Column:
    """The next double above a positive one: half a unit in the last place more always rounds up to it."""
    return x + F.greatest(x * dbl(2.0**-53 * 1.5), dbl(5e-324))


def calibrated_threshold(rows: DataFrame, target: float) -> DataFrame:
    """(threshold, achieved, n): the smallest threshold whose false-positive rate on the benign rows is at most target.

    It is the next double above the (k+1)-th largest benign score, k = floor(target n), 0 if k is n or more, and
    never below 0. Scores that are null or not finite, and a target that only a threshold above 1 meets, raise.
    """
    ben = rows.where("label = 0")
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == dbl("inf"))
    at = score_steps(ben.withColumn("label", F.lit(0))).crossJoin(F.broadcast(ben.agg(F.count_if(bad).alias("nbad"))))
    k = F.floor(dbl(target) * F.col("nn") + dbl(1e-9))
    above = F.max(F.when(F.col("fp") >= k + 1, F.col("score")))
    got = at.agg(F.max("nn").alias("n"), F.max("nbad").alias("nbad"), F.max(F.col("nn") - k).alias("room"), above.alias("above"), F.max(F.when(F.col("fp") < k + 1, F.col("fp"))).alias("achieved"), F.max(F.when(F.col("score") >= 0, F.col("fp"))).alias("not_below_0"))
    got = got.withColumn("t", F.when(F.col("room") <= 0, dbl(0)).when(F.col("above") < 0, dbl(0)).when(F.col("above") == 0, dbl(5e-324)).otherwise(next_up(F.col("above"))))
    t = F.when(F.col("nbad") > 0, F.raise_error(F.lit("benign scores must be finite"))).when(F.col("t") > 1, F.raise_error(F.lit("no threshold up to 1 meets the target"))).otherwise(F.col("t"))
    achieved = F.when(F.col("room") <= 0, F.col("not_below_0")).when(F.col("above") < 0, F.col("not_below_0")).otherwise(F.col("achieved"))
    return got.select(t.alias("threshold"), (F.coalesce(achieved, F.lit(0)) / F.col("n")).alias("achieved"), "n")


def attack_metrics(rows: DataFrame, decision: float) -> DataFrame:
    """Advantage (tpr - fpr) at a decision threshold, the best one and where it is (the highest threshold wins), AUROC,
    and the tpr at 1 % fpr, in one pass over the distinct scores."""
    at = score_steps(rows)
    tpr, fpr = ratio(F.col("tp"), F.col("np")), ratio(F.col("fp"), F.col("nn"))
    gain = tpr - fpr
    hit = F.col("score") >= dbl(decision)
    got = at.agg(
        F.greatest(F.max(gain), dbl(0)).alias("best_advantage"),
        F.max_by("score", F.struct(gain, "score")).alias("at"),
        F.max("score").alias("top"),
        F.max(gain).alias("most"),
        F.coalesce(F.max(F.when(fpr <= dbl(0.01 + 1e-12), tpr)), dbl(0)).alias("tpr_at_1pct"),
        F.coalesce(F.max(F.when(hit, tpr)), dbl(0)).alias("tpr"),
        F.coalesce(F.max(F.when(hit, fpr)), dbl(0)).alias("fpr"),
        F.sum(F.col("p").cast("double") * (F.col("nn") - F.col("fp") + F.col("n") / dbl(2))).alias("won"),
        F.max(F.col("np").cast("double") * F.col("nn")).alias("pairs"),
    )
    threshold = F.when(F.col("most") > 0, F.col("at")).otherwise(F.col("top") + dbl(1))  # no threshold beats calling nobody a member
    return got.select("best_advantage", threshold.alias("best_threshold"), "tpr_at_1pct", (F.col("tpr") - F.col("fpr")).alias("advantage"), ratio(F.col("won"), F.col("pairs")).alias("auroc"))


def performance(rows: DataFrame, threshold: float, max_fpr: float, bins: int = 15) -> DataFrame:
    """One row: confusion, rates with intervals, AUROC, AUPRC, Brier score, ECE, tpr at fixed fprs and the threshold that
    keeps max_fpr, all from one pass over the distinct scores."""
    at = score_steps(rows)
    s, p, n, tp, fp, mal, ben = (F.col(c) for c in ("score", "p", "n", "tp", "fp", "np", "nn"))
    hit, tpr, fpr = s >= dbl(threshold), ratio(tp, mal), ratio(fp, ben)
    k = F.greatest(F.least(F.ceil(s * dbl(bins)) - 1, F.lit(bins - 1)), F.lit(0))
    part = at.groupBy(k.alias("bin")).agg(
        F.max(mal).alias("np"), F.max(ben).alias("nn"),
        F.max(F.when(hit, tp)).alias("tp"), F.max(F.when(hit, fp)).alias("fp"),
        F.sum(p.cast("double") * (ben - fp + n / dbl(2))).alias("won"),
        F.sum(ratio(p, mal) * ratio(tp, tp + fp)).alias("ap"),
        F.sum(p * F.pow(s - dbl(1), dbl(2)) + n * F.pow(s, dbl(2))).alias("square"),
        F.abs(F.sum(p) - F.sum(s * (p + n))).alias("off"),
        F.max(F.when(fpr <= dbl(0.001), tpr)).alias("t1"), F.max(F.when(fpr <= dbl(0.01), tpr)).alias("t2"),
        F.min(F.when(fpr <= dbl(max_fpr), s)).alias("t"),
    )
    both = (F.max("np") > 0) & (F.max("nn") > 0)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0))
    got = part.agg(
        F.max("nn").alias("n_benign"), F.max("np").alias("n_malicious"), zero("tp").alias("tp"), zero("fp").alias("fp"),
        F.when(both, F.sum("won") / (F.max("np").cast("double") * F.max("nn"))).alias("auroc"), F.when(both, F.sum("ap")).alias("auprc"),
        (F.sum("square") / (F.max("np") + F.max("nn"))).alias("brier"), (F.sum("off") / (F.max("np") + F.max("nn"))).alias("ece"),
        F.when(both, zero("t1")).cast("double").alias("tpr_at_fpr_001"), F.when(both, zero("t2")).cast("double").alias("tpr_at_fpr_01"),
        F.when(both, F.min("t")).alias("threshold_at_max_fpr"),
    )
    tp, fp, mal, ben = (F.col(c) for c in ("tp", "fp", "n_malicious", "n_benign"))
    (dlo, dhi), (flo, fhi) = wilson(tp, mal), wilson(fp, ben)
    return got.withColumns({"detection_rate": ratio(tp, mal), "fpr": ratio(fp, ben), "detection_lo": dlo, "detection_hi": dhi, "fpr_lo": flo, "fpr_hi": fhi})
