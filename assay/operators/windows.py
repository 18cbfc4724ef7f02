"""Time windows after a cut-off, and how metrics move over them."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.metrics import auroc, confusion, dbl, ratio, wilson


STEPS = {"month": 1, "quarter": 3, "year": 12}
GRANULARITIES = ("day", "week", *STEPS)


def norm_granularity(text: str) -> str:
    """day, week, month, quarter, year or auto, in any case, also in the plural."""
    s = text.strip().lower() if isinstance(text, str) else ""
    s = s[:-1] if s[:-1] in GRANULARITIES and s.endswith("s") else s
    if s not in (*GRANULARITIES, "auto"):
        raise ValueError(f"a granularity is one of {', '.join(GRANULARITIES)} or auto, not {text!r}")
    return s


def granularity_of(text: Column) -> Column:
    """The same of a column; null for what is no granularity."""
    s = F.lower(F.trim(text))
    one = F.regexp_replace(s, "s$", "")
    return F.when(one.isin(*GRANULARITIES), one).when(s == "auto", s)


def _start(cutoff: str) -> datetime.date:
    return datetime.date.fromisoformat(cutoff) + datetime.timedelta(days=1)


def _month_end(months: int) -> int:
    return calendar.monthrange(months // 12, months % 12 + 1)[1]


def _bound_day(k: Column, start: datetime.date, step: str) -> Column:
    """Day of the month of bound k (0: the start). Each bound is its predecessor some months on, so a day that a short
    month has cut stays cut: at most three changes, found here for the longest calendar there is."""
    size, month = STEPS[step], start.year * 12 + start.month - 1
    day, out = start.day, F.lit(start.day)
    for i in range(1, (9999 * 12 - month) // size):
        if (end := _month_end(month + i * size)) < day:
            day = end
            out = F.when(k >= i, F.lit(day)).otherwise(out)
        if day <= 28:
            break
    return out


def window_number(day: Column, cutoff: str, step: str) -> Column:
    """1 for the window that begins the day after the cut-off, and so on; null up to the cut-off.

    step: day, week (seven days), month, quarter or year."""
    start = _start(cutoff)
    if step in ("day", "week"):
        k = F.floor(F.datediff(day, F.lit(start)) / (7 if step == "week" else 1))
    else:
        months = (F.year(day) - start.year) * 12 + F.month(day) - start.month
        at = F.floor(months / STEPS[step])
        k = at - F.when((months % STEPS[step] == 0) & (F.dayofmonth(day) < _bound_day(at, start, step)), 1).otherwise(0)
    return F.when(day >= F.lit(start), k + 1).cast("int")


def window_bounds(k: Column, cutoff: str, step: str) -> tuple[Column, Column]:
    """First and last day of window k."""
    start = _start(cutoff)

    def bound(i: Column) -> Column:
        if step in ("day", "week"):
            return F.date_add(F.lit(start), (i * (7 if step == "week" else 1)).cast("int"))
        months = F.lit(start.year * 12 + start.month - 1) + i * STEPS[step]
        return F.make_date(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), _bound_day(i, start, step))

    return bound(k - 1), F.date_sub(bound(k), 1)


def window_label(start: Column, end: Column, step: str) -> Column:
    """2018-01, 2018Q1, 2018 for periods that begin with a calendar period, an ISO day for days, else start..end."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    span = F.concat(iso(start), F.lit(".."), iso(end))
    first = F.dayofmonth(start) == 1
    if step == "month":
        return F.when(first, F.date_format(start, "yyyy-MM")).otherwise(span)
    if step == "quarter":
        return F.when(first & (F.month(start) % 3 == 1), F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string"))).otherwise(span)
    if step == "year":
        return F.when(first & (F.month(start) == 1), F.date_format(start, "yyyy")).otherwise(span)
    return iso(start) if step == "day" else span


def windowed(rows: DataFrame, cutoff: str, step: str) -> DataFrame:
    return rows.withColumn("k", window_number(F.col("timestamp"), cutoff, step)).where("k is not null")


def window_metrics(rows: DataFrame, cutoff: str, step: str, threshold: float) -> DataFrame:
    return confusion(windowed(rows, cutoff, step), threshold, "k")


def window_rows(rows: DataFrame, cutoff: str, step: str, threshold: float, least: int = 200, least_benign: int = 100, both: bool = True) -> DataFrame:
    """A row for each window with rows: bounds, label, confusion, rates with intervals, AUROC, the gap between the classes'
    median months, and its status."""
    inside = windowed(rows.where("label >= 0"), cutoff, step)
    m = window_status(confusion(inside, threshold, "k"), least, least_benign, both)
    medians = time_constraints(rows, cutoff, step).select("k", F.abs(_months(F.col("median_malicious")) - _months(F.col("median_benign"))).alias("gap_months"))
    (flo, fhi), (mlo, mhi) = wilson(F.col("fp"), F.expr("fp + tn")), wilson(F.col("fn"), F.expr("tp + fn"))
    start, end = window_bounds(F.col("k"), cutoff, step)
    out = m.join(auroc(inside, "k"), "k").join(medians, "k")
    return out.withColumns({"start": start, "end": end, "window": window_label(start, end, step), "n_mal": F.expr("tp + fn"), "n_ben": F.expr("fp + tn"), "malware_ratio": ratio(F.expr("tp + fn"), F.col("n")), "fnr": ratio(F.col("fn"), F.expr("tp + fn")), "fpr_lo": flo, "fpr_hi": fhi, "fnr_lo": mlo, "fnr_hi": mhi})


def _months(day_number: Column) -> Column:
    d = F.date_from_unix_date(F.bround(day_number).cast("int"))
    return F.year(d) * 12 + F.month(d)


def operating_stats(rows: DataFrame, threshold: float, *by: str) -> DataFrame:
    """AUROC, miss rate and false-positive rate with their intervals, for all rows or groups of them."""
    c = confusion(rows, threshold, *by)
    (flo, fhi), (mlo, mhi) = wilson(F.col("fp"), F.expr("fp + tn")), wilson(F.col("fn"), F.expr("tp + fn"))
    c = c.withColumns({"fnr": ratio(F.col("fn"), F.expr("tp + fn")), "fnr_lo": mlo, "fnr_hi": mhi, "fpr_lo": flo, "fpr_hi": fhi})
    a = auroc(rows, *by)
    return (c.join(a, list(by)) if by else c.crossJoin(a)).select(*by, "auroc", "fnr", "fnr_lo", "fnr_hi", "fpr", "fpr_lo", "fpr_hi")  # one row each without groups


def max_window_fpr(windows: DataFrame) -> DataFrame:
    """First and last window's AUROC, miss rate and fpr, and the window (of those with enough benign rows) whose fpr is largest."""
    used = windows.where("status = 'used'")
    ends = [f(c, "k").alias(f"{c}_{name}") for name, f in (("first", F.min_by), ("last", F.max_by)) for c in ("auroc", "fnr", "fpr")]
    top = F.max_by(F.struct("window", "fpr", "fpr_lo", "fpr_hi"), F.when(F.col("fpr_evaluable"), F.struct("fpr", (-F.col("k")).alias("k"))))
    return used.agg(*ends, top.alias("top")).select(*[f"{c}_{n}" for n in ("first", "last") for c in ("auroc", "fnr", "fpr")], F.col("top.window").alias("max_window"), F.col("top.fpr").alias("max_window_fpr"), F.col("top.fpr_lo").alias("max_window_lo"), F.col("top.fpr_hi").alias("max_window_hi"))


def auto_granularity(rows: DataFrame, cutoff: str, least: int = 200, least_benign: int = 100, most: int = 36) -> DataFrame:
    """One row: week or month, and why. Weeks need dates on different days of the month, four to `most` windows, and
    95 % of the rows in windows with enough rows, enough benign ones and a malicious one."""
    cand = windowed(rows.where("label >= 0"), cutoff, "week")
    weeks = cand.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("ben"), F.count_if(F.col("label") == 1).alias("mal"), F.min(F.dayofmonth("timestamp")).alias("d0"), F.max(F.dayofmonth("timestamp")).alias("d1"))
    good = (F.col("n") >= least) & (F.col("ben") >= least_benign) & (F.col("mal") > 0)
    a = weeks.agg(F.count(F.lit(1)).alias("weeks"), F.sum("n").alias("n"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("ok"), (F.coalesce(F.min("d0") != F.max("d1"), F.lit(False))).alias("day_level"))
    cover = F.coalesce(ratio(F.col("ok"), F.col("n")), dbl(0))
    why = F.when(~F.col("day_level"), "month_level_dates").when(F.col("weeks") < 4, "few_weeks").when(F.col("weeks") > most, "many_weeks").when(cover < dbl(0.95), "thin_weeks").otherwise("weeks_hold")
    return a.select(F.when(why == "weeks_hold", "week").otherwise("month").alias("granularity"), why.alias("reason"), "day_level", "weeks", cover.alias("cover"))


def window_status(metrics: DataFrame, least: int, least_benign: int, both: bool = True) -> DataFrame:
    """used, or why a window is left out."""
    n, mal = F.expr("tp + fp + fn + tn"), F.expr("tp + fn")
    why = F.when(n < least, "too_small").when(mal == 0, "no_malicious").when((n == mal) & F.lit(both), "no_benign").otherwise("used")
    return metrics.withColumn("n", n).withColumn("status", why).withColumn("fpr_evaluable", F.expr("fp + tn") >= max(1, least_benign))


def area_under_time(metrics: DataFrame, value: str = "f1") -> DataFrame:
    """Mean trapezoid over consecutive windows, plain and weighted by size; null below two windows.

    Windows are calendar periods: few rows, one ordered pass."""
    w = Window.orderBy("k")
    pair = metrics.withColumn("n", F.expr("cast(tp + fp + fn + tn as double)")).select(F.col("n"), F.col(value).alias("f"), F.lead("n").over(w).alias("n2"), F.lead(value).over(w).alias("f2")).where("n2 is not null")
    return pair.agg(F.avg((F.col("f") + F.col("f2")) / dbl(2)).alias("aut"), ratio(F.sum(F.col("n") * F.col("f") + F.col("n2") * F.col("f2")), F.sum(F.col("n") + F.col("n2"))).alias("aut_weighted"))


def change(metrics: DataFrame, value: str = "f1") -> DataFrame:
    return metrics.agg(F.min_by(value, "k").alias("first"), F.max_by(value, "k").alias("last"), F.min(value).alias("least"), F.max("fpr").alias("max_fpr")).withColumn("delta", F.col("last") - F.col("first"))


def fpr_budget(metrics: DataFrame, most: float, least_benign: int) -> DataFrame:
    """Windows over the budget by their estimate and by the lower end of its interval, and the largest lower end."""
    lo, _ = wilson(F.col("fp"), F.col("fp") + F.col("tn"))
    m = metrics.withColumn("benign", F.col("fp") + F.col("tn")).withColumn("lo", lo)
    ok = F.col("benign") >= max(1, least_benign)
    return m.agg(F.count_if(ok).alias("n_evaluable"), F.count_if(~ok).alias("n_unevaluable"), F.count_if(ok & (F.col("fpr") > dbl(most))).alias("n_over"), F.count_if(ok & (F.col("lo") > dbl(most))).alias("n_surely_over"), F.max(F.when(ok, F.col("lo"))).alias("worst_lower_bound"))


def time_constraints(rows: DataFrame, cutoff: str, step: str) -> DataFrame:
    """Median day of each class in each window, and the malicious share."""
    w = windowed(rows.where("label >= 0"), cutoff, step).withColumn("d", F.unix_date("timestamp").cast("double"))
    med = lambda label: F.percentile(F.when(F.col("label") == label, F.col("d")), 0.5)
    return w.groupBy("k").agg(med(1).alias("median_malicious"), med(0).alias("median_benign"), F.avg(F.col("label").cast("double")).alias("malicious_share"))


def consistent_in_time(rows: DataFrame) -> DataFrame:
    """No training row is dated after a test row."""
    return rows.agg(F.max(F.when(F.col("split") == "train", F.col("timestamp"))).alias("last_train"), F.min(F.when(F.col("split") == "test", F.col("timestamp"))).alias("first_test")).withColumn("consistent", F.coalesce(F.col("last_train") <= F.col("first_test"), F.lit(True)))


def earliest_slice(rows: DataFrame, share: int = 10, slack: float = 2.0) -> DataFrame:
    """The earliest ceil(n / share) dated rows by day and hash, completed to the last day if that at most doubles them.

    Day counts (as many rows as days) fix the boundary day; only its rows are ranked."""
    dated = rows.where("timestamp is not null")
    days = dated.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"))
    run = days.withColumn("upto", F.sum("n").over(Window.orderBy("timestamp"))).crossJoin(F.broadcast(dated.agg(F.ceil(F.count(F.lit(1)) / share).alias("want"))))
    edge = run.where("upto >= want").agg(F.min_by(F.struct("timestamp", "n", "upto", "want"), "timestamp").alias("e")).select("e.*")
    edge = edge.select(F.col("timestamp").alias("last_day"), F.expr(f"if(upto <= want * {slack}D, n, want - (upto - n))").alias("take"))
    got = dated.crossJoin(F.broadcast(edge)).where("timestamp <= last_day")  # one row
    rank = F.row_number().over(Window.partitionBy("timestamp").orderBy("sha256", "row_id"))
    last = got.where("timestamp = last_day").withColumn("r", rank).where("r <= take").drop("r")
    return got.where("timestamp < last_day").unionByName(last).drop("last_day", "take")
