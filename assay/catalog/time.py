from pyspark.sql import functions as F

from assay.catalog.metrics import CONF, R
from assay.catalog.sql import EVENTS, LINES, wilson
from assay.operators import windows as W
from assay.catalog.base import query
from assay.sources.corpora import events_corpus, line_corpus

CUT = "1998-12-31"
MONTH = "(year(timestamp) - 1999) * 12 + month(timestamp)"
_M = f"WITH {LINES}, w AS (SELECT CAST({MONTH} AS INTEGER) AS k, {CONF} FROM li WHERE label >= 0 AND timestamp > DATE '{CUT}' GROUP BY k), m AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr, (tp + fp + fn + tn)::DOUBLE AS n FROM w)"


def months(spark, sf):
    return W.window_metrics(line_corpus(spark, sf), CUT, "month", 0.5)


@query("partition_windows", f"{_M} SELECT k, tp, fp, fn, tn, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM m")
def _(spark, sf):
    return R(months(spark, sf).select("k", "tp", "fp", "fn", "tn", "f1", "fpr"), "f1", "fpr")


@query("partition_windows_week", f"WITH {EVENTS} SELECT CAST(floor(datediff('day', DATE '2024-01-11', timestamp) / 7) + 1 AS INTEGER) AS k, count(*) AS n, count(*) FILTER (label = 1) AS malicious FROM ev WHERE label >= 0 AND timestamp > DATE '2024-01-10' GROUP BY k")
def _(spark, sf):
    return W.windowed(events_corpus(spark, sf).where("label >= 0"), "2024-01-10", "week").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("malicious"))


@query("partition_windows_quarter", f"WITH {LINES} SELECT CAST(floor(({MONTH} - 1) / 3) + 1 AS INTEGER) AS k, count(*) AS n FROM li WHERE timestamp > DATE '{CUT}' GROUP BY k")
def _(spark, sf):
    return W.windowed(line_corpus(spark, sf), CUT, "quarter").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("window_label", f"WITH {LINES} SELECT DISTINCT strftime(timestamp, '%Y-%m') AS month, CAST(year(timestamp) AS VARCHAR) || 'Q' || CAST(quarter(timestamp) AS VARCHAR) AS quarter, strftime(date_trunc('month', timestamp) + INTERVAL 14 DAY, '%Y-%m-%d') || '..' || strftime(date_trunc('month', timestamp) + INTERVAL 1 MONTH + INTERVAL 13 DAY, '%Y-%m-%d') AS middle FROM li")
def _(spark, sf):
    first = F.trunc("timestamp", "month")
    end = F.last_day(first)
    middle = W.window_label(F.date_add(first, 14), F.date_add(F.add_months(first, 1), 13), "month")
    return line_corpus(spark, sf).select(W.window_label(first, end, "month").alias("month"), W.window_label(F.trunc("timestamp", "quarter"), end, "quarter").alias("quarter"), middle.alias("middle")).distinct()


@query("window_bounds", "SELECT k::INTEGER AS k, CASE k WHEN 1 THEN DATE '2024-01-31' WHEN 2 THEN DATE '2024-02-29' ELSE CAST(DATE '2024-02-29' + to_months((k - 2)::INTEGER) AS DATE) END AS first, CAST(CAST(CASE k WHEN 1 THEN DATE '2024-02-29' ELSE DATE '2024-02-29' + to_months((k - 1)::INTEGER) END AS DATE) - INTERVAL 1 DAY AS DATE) AS last FROM range(1, 12) t(k)")
def _(spark, sf):
    first, last = W.window_bounds(F.col("k"), "2024-01-30", "month")
    return spark.range(1, 12).select(F.col("id").cast("int").alias("k")).select("k", first.alias("first"), last.alias("last"))


@query("select_windows", f"{_M} SELECT k, CAST(n AS BIGINT) AS n, CASE WHEN n < 150 THEN 'too_small' WHEN tp + fn = 0 THEN 'no_malicious' WHEN n = tp + fn THEN 'no_benign' ELSE 'used' END AS status, fp + tn >= 100 AS fpr_evaluable FROM m")
def _(spark, sf):
    return W.window_status(months(spark, sf), 150, 100).select("k", F.col("n").cast("bigint").alias("n"), "status", "fpr_evaluable")


@query("max_windows_cut", f"{_M} SELECT k FROM m ORDER BY k LIMIT 6")
def _(spark, sf):
    return months(spark, sf).select("k").orderBy("k").limit(6)


_AUT = f"{_M}, p AS (SELECT n, f1 AS f, lead(n) OVER (ORDER BY k) AS n2, lead(f1) OVER (ORDER BY k) AS f2 FROM m) SELECT round(avg((f + f2) / 2), 6) AS aut, round(sum(n * f + n2 * f2) / sum(n + n2), 6) AS aut_weighted FROM p WHERE n2 IS NOT NULL"


@query("aut_unweighted", _AUT.replace(", round(sum(n * f + n2 * f2) / sum(n + n2), 6) AS aut_weighted", ""))
def _(spark, sf):
    return R(W.area_under_time(months(spark, sf)).select("aut"), "aut")


@query("aut_weighted", _AUT)
def _(spark, sf):
    return R(W.area_under_time(months(spark, sf)), "aut", "aut_weighted")


@query("f1_drop", f"{_M} SELECT round(arg_min(f1, k), 6) AS first, round(arg_max(f1, k), 6) AS last, round(min(f1), 6) AS least, round(max(fpr), 6) AS max_fpr, round(arg_max(f1, k) - arg_min(f1, k), 6) AS delta FROM m")
def _(spark, sf):
    return R(W.change(months(spark, sf)), "first", "last", "least", "max_fpr", "delta")


@query("fpr_budget", f"{_M}, l AS (SELECT *, {wilson('fp', '(fp + tn)', 'lo')} AS lo FROM m) SELECT count(*) FILTER (fp + tn >= 60) AS n_evaluable, count(*) FILTER (fp + tn < 60) AS n_unevaluable, count(*) FILTER (fp + tn >= 60 AND fpr > 0.01) AS n_over, count(*) FILTER (fp + tn >= 60 AND lo > 0.01) AS n_surely_over, round(max(lo) FILTER (fp + tn >= 60), 6) AS worst_lower_bound FROM l")
def _(spark, sf):
    return R(W.fpr_budget(months(spark, sf), 0.01, 60), "worst_lower_bound")


@query("c1_consistency", f"WITH {EVENTS} SELECT max(timestamp) FILTER (split = 'train') AS last_train, min(timestamp) FILTER (split = 'test') AS first_test, max(timestamp) FILTER (split = 'train') <= min(timestamp) FILTER (split = 'test') AS consistent FROM ev")
def _(spark, sf):
    return W.consistent_in_time(events_corpus(spark, sf))


@query("c2_c3_constraints", f"WITH {LINES}, d AS (SELECT CAST({MONTH} AS INTEGER) AS k, label, datediff('day', DATE '1970-01-01', timestamp)::DOUBLE AS d FROM li WHERE label >= 0 AND timestamp > DATE '{CUT}') SELECT k, quantile_cont(d, 0.5) FILTER (label = 1) AS median_malicious, quantile_cont(d, 0.5) FILTER (label = 0) AS median_benign, round(avg(label::DOUBLE), 6) AS malicious_share FROM d GROUP BY k")
def _(spark, sf):
    return R(W.time_constraints(line_corpus(spark, sf), CUT, "month"), "malicious_share")


@query("median_date", f"WITH {EVENTS} SELECT split, quantile_cont(datediff('day', DATE '1970-01-01', timestamp)::DOUBLE, 0.5) AS median_day FROM ev WHERE timestamp IS NOT NULL GROUP BY split")
def _(spark, sf):
    return events_corpus(spark, sf).where("timestamp is not null").groupBy("split").agg(F.percentile(F.unix_date("timestamp").cast("double"), 0.5).alias("median_day"))


@query("effective_cutoff", f"WITH {EVENTS}, m AS (SELECT DISTINCT sha256 FROM ev WHERE split = 'train' AND row_id % 3 <> 0) SELECT greatest(DATE '2024-01-08', max(timestamp)) AS cutoff, count(*) FILTER (timestamp > DATE '2024-01-08') AS n_later FROM ev WHERE sha256 IN (SELECT sha256 FROM m)")
def _(spark, sf):
    from assay.operators.selection import select_rows
    from assay.sources.corpora import training_hashes

    ev = events_corpus(spark, sf)
    declared = F.lit("2024-01-08").cast("date")
    return select_rows(ev, labeled_only=False, include=training_hashes(ev)).agg(F.greatest(declared, F.max("timestamp")).alias("cutoff"), F.count_if(F.col("timestamp") > declared).alias("n_later"))


@query("earliest_slice", f"WITH {EVENTS}, d AS (SELECT *, row_number() OVER (ORDER BY timestamp, sha256, row_id) AS r, count(*) OVER () AS n, rank() OVER (ORDER BY timestamp) - 1 + count(*) OVER (PARTITION BY timestamp) AS upto FROM ev WHERE label = 0 AND timestamp IS NOT NULL), e AS (SELECT min(timestamp) AS day, min(upto) AS upto, max(ceil(n / 10.0)) AS want FROM d WHERE upto >= ceil(n / 10.0)) SELECT row_id FROM d, e WHERE d.timestamp <= e.day AND (r <= want OR e.upto <= want * 2.0)")
def _(spark, sf):
    return W.earliest_slice(events_corpus(spark, sf).where("label = 0")).select("row_id")


@query("period_meta", f"WITH {EVENTS} SELECT split, min(timestamp) AS first_day, max(timestamp) AS last_day, round(avg(CASE WHEN timestamp > DATE '2024-01-15' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_after FROM ev WHERE timestamp IS NOT NULL GROUP BY split")
def _(spark, sf):
    after = (F.col("timestamp") > F.lit("2024-01-15").cast("date")).cast("double")
    return R(events_corpus(spark, sf).where("timestamp is not null").groupBy("split").agg(F.min("timestamp").alias("first_day"), F.max("timestamp").alias("last_day"), F.avg(after).alias("share_after")), "share_after")


@query("exclusive_running_sum", "SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS base FROM lineitem")
def _(spark, sf):
    from pyspark.sql import Window

    from assay.sources.corpora import table

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)), 4).alias("base"))
