"""Queries of windows, pairing, the tree screen and whole modules."""

from pyspark.sql import functions as F

from assay.catalog.metrics import CONF, EV_STEPS, R
from assay.catalog.selection import NOT_MEMBER, eval_rows
from assay.catalog.sql import EVAL, EVENTS, LINES, MEMBERS, wilson
from assay.catalog.structure import DEPTH, NODES_SQL, TREES, WIDTH, checks, nodes
from assay.functions.scalars import dbl
from assay.operators import metrics as M
from assay.operators import pairing as P
from assay.operators import screen
from assay.operators import selection as S
from assay.operators import trees as T
from assay.operators import windows as W
from assay.plans import modules as MO
from assay.catalog.base import ORACLE_SQL, query
from assay.sources.corpora import events_corpus, line_corpus, table, training_hashes

CUT = "1998-12-31"
LEAST, LEAST_BENIGN = 20, 10
# window k of the line corpus by calendar months, its confusion, and the running counts of each score within it
_W = f"""li2 AS (SELECT *, CAST((year(timestamp) - 1999) * 12 + month(timestamp) AS INTEGER) AS k FROM li WHERE label >= 0 AND timestamp > DATE '{CUT}'),
  m AS (SELECT k, {CONF} FROM li2 GROUP BY k),
  g AS (SELECT k, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM li2 GROUP BY k, score),
  s AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY score) - n AS below FROM g),
  a AS (SELECT k, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)) END AS auroc FROM s GROUP BY k),
  med AS (SELECT k, median(datediff('day', DATE '1970-01-01', timestamp)) FILTER (label = 1) AS mm, median(datediff('day', DATE '1970-01-01', timestamp)) FILTER (label = 0) AS mb FROM li2 GROUP BY k),
  w AS (SELECT m.*, auroc, tp + fn AS n_mal, fp + tn AS n_ben, tp + fp + fn + tn AS n, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr, CASE WHEN tp + fn > 0 THEN fn / (tp + fn) END AS fnr,
    CASE WHEN tp + fp + fn + tn < {LEAST} THEN 'too_small' WHEN tp + fn = 0 THEN 'no_malicious' WHEN fp + tn = 0 THEN 'no_benign' ELSE 'used' END AS status, fp + tn >= {LEAST_BENIGN} AS fpr_evaluable, make_date(1999 + (k - 1) // 12, (k - 1) % 12 + 1, 1) AS start,
    abs(year(DATE '1970-01-01' + round_even(mm, 0)::INTEGER) * 12 + month(DATE '1970-01-01' + round_even(mm, 0)::INTEGER) - year(DATE '1970-01-01' + round_even(mb, 0)::INTEGER) * 12 - month(DATE '1970-01-01' + round_even(mb, 0)::INTEGER)) AS gap_months
    FROM m JOIN a USING (k) JOIN med USING (k))"""


def windows(spark, sf):
    return W.window_rows(line_corpus(spark, sf), CUT, "month", 0.5, LEAST, LEAST_BENIGN)


@query("window_row", f"""WITH {LINES}, {_W} SELECT k, strftime(start, '%Y-%m') AS "window", start, last_day(start) AS "end", n, n_mal, n_ben, round(n_mal / n, 6) AS malware_ratio, round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round({wilson('fp', 'n_ben', 'lo')}, 6) AS fpr_lo, round({wilson('fn', 'n_mal', 'hi')}, 6) AS fnr_hi, round(auroc, 6) AS auroc, gap_months, status FROM w""")
def _(spark, sf):
    return R(windows(spark, sf), "malware_ratio", "f1", "fpr", "fnr", "fpr_lo", "fnr_hi", "auroc").select("k", "window", "start", "end", "n", "n_mal", "n_ben", "malware_ratio", "f1", "fpr", "fnr", "fpr_lo", "fnr_hi", "auroc", "gap_months", "status")


@query("max_window_fpr", f"""WITH {LINES}, {_W}, u AS (SELECT * FROM w WHERE status = 'used'), t AS (SELECT * FROM u WHERE fpr_evaluable ORDER BY fpr DESC, k LIMIT 1) SELECT round(min_by(auroc, k), 6) AS auroc_first, round(max_by(auroc, k), 6) AS auroc_last, round(min_by(fnr, k), 6) AS fnr_first, round(max_by(fnr, k), 6) AS fnr_last, (SELECT strftime(start, '%Y-%m') FROM t) AS max_window, round((SELECT fpr FROM t), 6) AS max_window_fpr, round((SELECT {wilson('fp', 'n_ben', 'lo')} FROM t), 6) AS max_window_lo FROM u""")
def _(spark, sf):
    got = W.max_window_fpr(windows(spark, sf)).select("auroc_first", "auroc_last", "fnr_first", "fnr_last", "max_window", "max_window_fpr", "max_window_lo")
    return R(got, "auroc_first", "auroc_last", "fnr_first", "fnr_last", "max_window_fpr", "max_window_lo")


@query("operating_stats", f"""WITH {LINES}, {_W} SELECT k, round(auroc, 6) AS auroc, round(fnr, 6) AS fnr, round({wilson('fn', 'n_mal', 'lo')}, 6) AS fnr_lo, round({wilson('fn', 'n_mal', 'hi')}, 6) AS fnr_hi, round(fpr, 6) AS fpr, round({wilson('fp', 'n_ben', 'lo')}, 6) AS fpr_lo, round({wilson('fp', 'n_ben', 'hi')}, 6) AS fpr_hi FROM w""")
def _(spark, sf):
    rows = W.windowed(line_corpus(spark, sf).where("label >= 0"), CUT, "month")
    return R(W.operating_stats(rows, 0.5, "k"), "auroc", "fnr", "fnr_lo", "fnr_hi", "fpr", "fpr_lo", "fpr_hi")


@query("auto_granularity", f"WITH {EVENTS}, c AS (SELECT *, floor(datediff('day', DATE '2024-01-11', timestamp) / 7) AS k FROM ev WHERE label >= 0 AND timestamp > DATE '2024-01-10'), w AS (SELECT k, count(*) AS n, count(*) FILTER (label = 0) AS ben, count(*) FILTER (label = 1) AS mal FROM c GROUP BY k), a AS (SELECT count(*) AS weeks, sum(n) AS n, coalesce(sum(n) FILTER (n >= 20 AND ben >= 10 AND mal > 0), 0) AS ok, (SELECT count(DISTINCT day(timestamp)) > 1 FROM c) AS day_level FROM w) SELECT CASE WHEN day_level AND weeks BETWEEN 4 AND 36 AND ok / n >= 0.95 THEN 'week' ELSE 'month' END AS granularity, CASE WHEN NOT day_level THEN 'month_level_dates' WHEN weeks < 4 THEN 'few_weeks' WHEN weeks > 36 THEN 'many_weeks' WHEN ok / n < 0.95 THEN 'thin_weeks' ELSE 'weeks_hold' END AS reason, day_level, weeks, round(ok / n, 6) AS cover FROM a")
def _(spark, sf):
    return R(W.auto_granularity(events_corpus(spark, sf), "2024-01-10", 20, 10), "cover")


_FIRST = "SELECT max(nn)::BIGINT AS nn, max(np)::BIGINT AS np, coalesce(max(tp) FILTER (score >= 0.5), 0)::BIGINT AS tp, coalesce(max(fp) FILTER (score >= 0.5), 0)::BIGINT AS fp, sum(p * (nn - fp + n / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn)) AS auroc, sum(p / np * (tp / (tp + fp))) AS auprc, sum(p * pow(score - 1, 2) + n * pow(score, 2)) / (max(np) + max(nn)) AS brier, coalesce(max(tp / np) FILTER (fp / nn <= 0.001::DOUBLE), 0) AS t1, coalesce(max(tp / np) FILTER (fp / nn <= 0.01::DOUBLE), 0) AS t2, min(score) FILTER (fp / nn <= 0.01::DOUBLE) AS t FROM c"
_ECE = "SELECT sum(abs(y - s)) / sum(n) AS ece FROM (SELECT greatest(least(ceil(score * 15.0::DOUBLE) - 1, 14), 0) AS b, sum(label) AS y, sum(score) AS s, count(*) AS n FROM eval GROUP BY b)"
_OUT = f"SELECT count(*) FILTER (label = 0 AND NOT ({NOT_MEMBER})) AS excluded_benign, count(*) FILTER (label = 1 AND NOT ({NOT_MEMBER})) AS excluded_malicious, count(*) FILTER (label = 0 AND {NOT_MEMBER}) - (SELECT count(*) FROM eval WHERE label = 0) AS repeats_benign, count(*) FILTER (label = 1 AND {NOT_MEMBER}) - (SELECT count(*) FROM eval WHERE label = 1) AS repeats_malicious FROM ev WHERE split = 'test' AND label >= 0"


def _graded(v: str, t: float, ideal: float, floor: float, up: bool, log: bool) -> str:
    ax = lambda x: ("" if up else "-") + (f"log10(greatest({x}, 1e-12::DOUBLE))" if log else f"({x})")
    a, b, c, d = ax(v), ax(f"{t}::DOUBLE"), ax(f"{ideal}::DOUBLE"), ax(f"{floor}::DOUBLE")
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {a} >= {c} THEN 1 WHEN {a} >= {b} THEN 0.75::DOUBLE + 0.25::DOUBLE * ({a} - {b}) / ({c} - {b}) WHEN {a} <= {d} THEN 0 ELSE least(0.75::DOUBLE * ({a} - {d}) / ({b} - {d}), 0.75::DOUBLE - 1e-6::DOUBLE) END"


_FPR_SCORE, _DET_SCORE = _graded("fp / nn", 0.01, 0.001, 0.05, False, True), _graded("tp / np", 0.95, 0.95 + 0.9 * 0.05, 0.95 - 0.15, True, False)


@query(
    "m1_performance",
    f"""{EV_STEPS}, f AS ({_FIRST}), e AS ({_ECE}), o AS ({_OUT}) SELECT nn AS n_benign, np AS n_malicious, tp, fp, round(tp / np, 6) AS detection_rate, round(fp / nn, 6) AS fpr, round({wilson('tp', 'np', 'lo')}, 6) AS detection_lo, round({wilson('fp', 'nn', 'hi')}, 6) AS fpr_hi, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, round(ece, 6) AS ece, round(t1, 6) AS tpr_at_fpr_001, round(t2, 6) AS tpr_at_fpr_01, t AS threshold_at_max_fpr,
  excluded_benign, excluded_malicious, repeats_benign, repeats_malicious, fp / nn <= 0.01::DOUBLE AS fpr_passed, round({_FPR_SCORE}, 6) AS fpr_score, tp / np >= 0.95::DOUBLE AS detection_passed, round({_DET_SCORE}, 6) AS detection_score FROM f, e, o""",
)
def m1(spark, sf):
    ev = events_corpus(spark, sf)
    got = MO.m1_performance(ev, training_hashes(ev), 0.5)
    c = lambda i, k: F.col("checks")[i][k]
    cols = ["n_benign", "n_malicious", "tp", "fp", "detection_rate", "fpr", "detection_lo", "fpr_hi", "auroc", "auprc", "brier", "ece", "tpr_at_fpr_001", "tpr_at_fpr_01", "threshold_at_max_fpr", "excluded_benign", "excluded_malicious", "repeats_benign", "repeats_malicious"]
    got = got.select(*cols, c(0, "passed").alias("fpr_passed"), c(0, "score").alias("fpr_score"), c(1, "passed").alias("detection_passed"), c(1, "score").alias("detection_score"))
    return R(got, "detection_rate", "fpr", "detection_lo", "fpr_hi", "auroc", "auprc", "brier", "ece", "tpr_at_fpr_001", "tpr_at_fpr_01", "fpr_score", "detection_score")


@query("m1_challenge", f"WITH {MEMBERS}, c AS (SELECT sha256, arg_min(score, row_id) AS score FROM ev WHERE split = 'challenge' AND label = 1 AND {NOT_MEMBER} GROUP BY sha256), n AS (SELECT count(*) AS n, count(*) FILTER (score >= 0.5) AS detected FROM c) SELECT n, detected, round(CASE WHEN n > 0 THEN detected / n END, 6) AS rate, round({wilson('detected', 'n', 'lo')}, 6) AS lo, round({wilson('detected', 'n', 'hi')}, 6) AS hi FROM n")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return R(MO.m1_challenge(ev, training_hashes(ev), 0.5), "rate", "lo", "hi")


def _calibration(spark, sf):
    """Benign eval rows: the hash slice calibrates, the rest is scored."""
    rows = eval_rows(spark, sf)
    held = S.hash_slice(F.col("sha256"))
    return rows.where(held & (F.col("label") == 0)), rows.where(~held | (F.col("label") == 1))


@query("threshold_bootstrap")
def _(spark, sf):
    return MO.threshold_bootstrap(*_calibration(spark, sf), 0.05, 0.05, 0.5, 200)


@query("m1_threshold_noise")
def _(spark, sf):
    return MO.m1_threshold_noise(*_calibration(spark, sf), 0.05, 0.05, 0.5, 200)


@query("spot_check", f"WITH {EVAL}, p AS (SELECT row_id, score, row_number() OVER (ORDER BY sha256('5/' || CAST(row_id AS VARCHAR)), row_id) AS r FROM eval) SELECT count(*) AS n, count(*) FILTER ((score >= 0.5) <> (floor(score * 100 + 0.5) / 100 >= 0.5)) AS n_differ FROM p WHERE r <= 1000")
def _(spark, sf):
    """A thousand sampled rows: a hard prediction (here of a score rounded to two places) against score >= threshold."""
    rows = S.ordered_sample(eval_rows(spark, sf), 1000, 5)
    rounded = F.floor(F.col("score") * 100 + F.lit(0.5)) / 100
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("score") >= 0.5) != (rounded >= 0.5)).alias("n_differ"))


_DRIFT = f"""u AS (SELECT *, lead(n) OVER (ORDER BY k) AS n2, lead(f1) OVER (ORDER BY k) AS f2 FROM w WHERE status = 'used' AND k <= 36),
  d AS (SELECT count(*) AS n_windows, avg((f1 + f2) / 2) FILTER (n2 IS NOT NULL) AS aut, sum(n * f1 + n2 * f2) FILTER (n2 IS NOT NULL) / sum(n + n2) FILTER (n2 IS NOT NULL) AS aut_weighted, min_by(f1, k) AS first, max_by(f1, k) AS last, min(f1) AS least, count(*) FILTER (fpr_evaluable AND fpr > 0.01::DOUBLE) AS n_over, max({wilson('fp', 'n_ben', 'lo')}) FILTER (fpr_evaluable) AS worst_lower_bound, max(fpr) FILTER (fpr_evaluable) AS max_window_fpr FROM u)"""


@query("m2_drift", f"WITH {LINES}, {_W}, {_DRIFT} SELECT n_windows, round(aut, 6) AS aut, round(aut_weighted, 6) AS aut_weighted, round(first, 6) AS first, round(last, 6) AS last, round(least, 6) AS least, round(last - first, 6) AS delta, n_over, round(worst_lower_bound, 6) AS worst_lower_bound, round(max_window_fpr, 6) AS max_window_fpr, round({_graded('aut_weighted', 0.7, 0.7 + 0.2, 0.7 - 0.3, True, False)}, 6) AS aut_score, aut_weighted >= 0.7::DOUBLE AS aut_passed, worst_lower_bound <= 0.01::DOUBLE AS fpr_passed FROM d")
def m2(spark, sf):
    got = MO.m2_drift(line_corpus(spark, sf), None, CUT, 0.5, "month", LEAST, LEAST_BENIGN)
    got = got.select("n_windows", "aut", "aut_weighted", "first", "last", "least", "delta", "n_over", "worst_lower_bound", "max_window_fpr", F.col("checks")[0]["score"].alias("aut_score"), F.col("checks")[0]["passed"].alias("aut_passed"), F.col("checks")[1]["passed"].alias("fpr_passed"))
    return R(got, "aut", "aut_weighted", "first", "last", "least", "delta", "worst_lower_bound", "max_window_fpr", "aut_score")


# Members and others of the line corpus: the manifest holds three in four hashes.
_LINE_SIDES = f"{LINES}, man AS (SELECT sha256 FROM li WHERE row_id % 4 <> 0), mem AS (SELECT * FROM li WHERE label >= 0 AND sha256 IN (SELECT sha256 FROM man)), oth AS (SELECT * FROM li WHERE label >= 0 AND sha256 NOT IN (SELECT sha256 FROM man))"


def _sides(spark, sf):
    li = line_corpus(spark, sf)
    return li, li.where("row_id % 4 <> 0").select("sha256")


@query("union_extra_pool", f"WITH {_LINE_SIDES} SELECT split, label, count(*) AS n FROM oth GROUP BY ALL")
def _(spark, sf):
    li, manifest = _sides(spark, sf)
    return P.candidates(li, manifest, ["train"]).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def _ranked(side: str, seed: int) -> str:
    return f"SELECT date_trunc('month', timestamp) AS month, label, row_id, row_number() OVER (PARTITION BY date_trunc('month', timestamp), label ORDER BY sha256('{seed}/' || CAST(row_id AS VARCHAR)), row_id) AS position FROM {side}"


_SAMPLE = f"{_LINE_SIDES}, a AS ({_ranked('mem', 3)}), b AS ({_ranked('oth', 3)}), ms AS (SELECT a.row_id AS member_row, b.row_id AS other_row FROM a JOIN b USING (month, label, position))"


@query("member_sample", f"WITH {_SAMPLE} SELECT * FROM ms")
def _(spark, sf):
    li, manifest = _sides(spark, sf)
    return P.member_sample(li, manifest, 3, 50, None)[0].select("member_row", "other_row")


def _near(side: str, other: str, name: str) -> str:
    return f"""{name}_d AS (SELECT x.row_id, x.label, x.timestamp, (SELECT min(abs(datediff('day', y.timestamp, x.timestamp))) FROM (SELECT DISTINCT label, timestamp FROM {other}) y WHERE y.label = x.label) AS d FROM {side} x),
  {name} AS (SELECT row_id, label, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, sha256('9/' || CAST(row_id AS VARCHAR)), row_id) AS r FROM {name}_d) JOIN quota USING (label) WHERE r <= k)"""


@query(
    "nearest_pairing",
    f"""WITH {EVENTS}, mem AS (SELECT * FROM ev WHERE split = 'train' AND label >= 0 AND timestamp IS NOT NULL), oth AS (SELECT * FROM ev WHERE split = 'test' AND label >= 0 AND timestamp IS NOT NULL),
  q AS (SELECT label, count(*) AS m, greatest(1, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0)) AS share FROM mem GROUP BY label), quota AS (SELECT label, CAST(least(m, share, (SELECT count(*) FROM oth WHERE oth.label = q.label)) AS BIGINT) AS k FROM q), {_near('mem', 'oth', 'pm')}, {_near('oth', 'pm', 'po')},
  a AS (SELECT label, row_id, row_number() OVER (PARTITION BY label ORDER BY sha256('10/' || CAST(row_id AS VARCHAR)), row_id) AS position FROM pm), b AS (SELECT label, row_id, row_number() OVER (PARTITION BY label ORDER BY sha256('10/' || CAST(row_id AS VARCHAR)), row_id) AS position FROM po)
  SELECT label, a.row_id AS member_row, b.row_id AS other_row FROM a JOIN b USING (label, position)""",
)
def _(spark, sf):
    ev = events_corpus(spark, sf).where("label >= 0 and timestamp is not null")
    return P.nearest_pairs(ev.where("split = 'train'"), ev.where("split = 'test'"), 100, 9).select("label", "member_row", "other_row")


@query("best_threshold", f"{EV_STEPS}, d AS (SELECT max(tp / np - fp / nn) AS best FROM c) SELECT CASE WHEN best > 0 THEN (SELECT max(score) FROM c, d WHERE tp / np - fp / nn = best) ELSE (SELECT max(score) + 1 FROM c) END AS best_threshold FROM d")
def _(spark, sf):
    return M.attack_metrics(eval_rows(spark, sf), 0.5).select("best_threshold")


_MEMBERSHIP = f"""{EVENTS}, ap AS (SELECT row_id, sha256, label, timestamp, CASE WHEN label = 0 THEN score + 0.00003::DOUBLE ELSE score END AS score FROM ev WHERE label >= 0 AND split <> 'challenge'), man AS (SELECT sha256 FROM ap WHERE row_id % 4 <> 0),
  mem AS (SELECT * FROM ap WHERE timestamp IS NOT NULL AND sha256 IN (SELECT sha256 FROM man)), oth AS (SELECT * FROM ap WHERE timestamp IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM man)),
  a AS ({_ranked('mem', 3)}), b AS ({_ranked('oth', 3)}), ms AS (SELECT a.row_id AS member_row, b.row_id AS other_row FROM a JOIN b USING (month, label, position)),
  pr AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sha256('5/' || CAST(member_row AS VARCHAR)), member_row) AS pair FROM ms) WHERE pair <= 5000),
  sp AS (SELECT *, row_number() OVER (ORDER BY sha256('3/' || CAST(pair AS VARCHAR)), pair) <= greatest(1, least(n - 1, round_even(n * 0.5::DOUBLE, 0))) AS test FROM pr, (SELECT count(*) AS n FROM pr)),
  rw AS (SELECT test, member, label, score, CASE WHEN label = 1 THEN ln(greatest(score, 1e-300::DOUBLE)) ELSE ln(1 - least(score, 1 - pow(2.0::DOUBLE, -53))) END AS conf FROM (SELECT test, member_row AS row_id, 1 AS member FROM sp UNION ALL SELECT test, other_row, 0 FROM sp) JOIN ap USING (row_id)),
  st AS (SELECT test, conf, count(*) FILTER (member = 1) AS p, count(*) FILTER (member = 0) AS n FROM rw GROUP BY ALL),
  c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY test) AS np, sum(n) OVER (PARTITION BY test) AS nn FROM st WINDOW w AS (PARTITION BY test ORDER BY conf DESC)),
  cut AS (SELECT CASE WHEN max(tp / np - fp / nn) > 0 THEN arg_max(conf, struct_pack(g := tp / np - fp / nn, s := conf)) ELSE max(conf) + 1 END AS t FROM c WHERE NOT test),
  am AS (SELECT coalesce(max(tp / np) FILTER (conf >= t), 0) - coalesce(max(fp / nn) FILTER (conf >= t), 0) AS advantage, greatest(max(tp / np - fp / nn), 0) AS best_advantage, sum(p * (nn - fp + n / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn)) AS auroc FROM c, cut WHERE test),
  ma AS (SELECT avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (member = 1) AS member_accuracy, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (member = 0) AS other_accuracy FROM rw)"""
_M4 = ["advantage", "best_advantage", "auroc", "member_accuracy", "other_accuracy", "score"]


def _apart(spark, sf):
    """Events and the hashes of three in four of them as members; benign scores lie off the grid of the malicious ones, so that no
    two classes' losses are equal but for their last bits."""
    ev = events_corpus(spark, sf).where("label >= 0 and split <> 'challenge'").withColumn("split", F.lit("test"))
    ev = ev.withColumn("score", F.when(F.col("label") == 0, F.col("score") + dbl(0.00003)).otherwise(F.col("score")))
    return ev, ev.where("row_id % 4 <> 0").select("sha256")


def _m4(spark, sf, models):
    got = MO.m4_membership(*_apart(spark, sf), 0.5, 3, least=50, models=models)
    return R(got.select("attack", *_M4[:-1], "n_pairs", "design", F.col("checks")[0]["passed"].alias("passed"), F.col("checks")[0]["score"].alias("score")), *_M4)


@query("m4_membership", f"WITH {_MEMBERSHIP} SELECT 'loss_threshold' AS attack, round(advantage, 6) AS advantage, round(best_advantage, 6) AS best_advantage, round(auroc, 6) AS auroc, round(member_accuracy, 6) AS member_accuracy, round(other_accuracy, 6) AS other_accuracy, (SELECT count(*) FROM pr) AS n_pairs, 'time_matched' AS design, advantage <= 0.1::DOUBLE AS passed, round({_graded('advantage', 0.1, 0.01, 0.3, False, False)}, 6) AS score FROM am, ma")
def m4(spark, sf):
    return _m4(spark, sf, ())


@query("m4_with_model")
def _(spark, sf):
    """The same with a fitted attack beside the threshold."""
    return _m4(spark, sf, ("rf",))


@query("attack_models")
def _(spark, sf):
    li, manifest = _sides(spark, sf)
    pairs, _design = P.member_sample(li, manifest, 3, 50, 2000)
    return MO.attack_scores(MO.pair_rows(li, pairs, 0.5, 3), "rf", 3)


@query("exclude_background", f"WITH {EVENTS}, e AS (SELECT row_id FROM ev WHERE split = 'test' AND label = 1) SELECT count(*) AS n FROM ev WHERE split = 'test' AND label >= 0 AND row_id NOT IN (SELECT row_id FROM e)")
def _(spark, sf):
    rows = S.select_rows(events_corpus(spark, sf), "eval")
    return S.exclude_background(rows, rows.where("label = 1")).agg(F.count(F.lit(1)).alias("n"))


# The fitted ensemble, its inner covers to be found from the leaves.
_TREES = f"""WITH RECURSIVE {NODES_SQL[5:]}, up AS (SELECT tree, node AS leaf, node, 0 AS steps FROM nodes WHERE NOT inner_ UNION ALL SELECT tree, leaf, (node - 1) // 2, steps + 1 FROM up WHERE node > 0),
  lf AS (SELECT tree, node AS leaf, value, cover FROM nodes WHERE NOT inner_), sub AS (SELECT tree, node, sum(cover) AS sub, sum(value * cover) / sum(cover) AS mean FROM up JOIN lf USING (tree, leaf) GROUP BY ALL),
  ed AS (SELECT c.tree, c.node, (c.node - 1) // 2 AS parent, p.feature AS gate_feature, p.gain AS parent_gain, sp.sub AS parent_cover, c.sub / sp.sub AS rho, c.sub, r.sub AS root_cover, c.sub / sp.sub <= 0.25 AND c.mean < b.mean AS gate, p.threshold AS cut, c.node % 2 = 1 AS below FROM sub c JOIN nodes p ON p.tree = c.tree AND p.node = (c.node - 1) // 2 JOIN sub sp ON sp.tree = c.tree AND sp.node = p.node JOIN sub b ON b.tree = c.tree AND b.node = CASE WHEN c.node % 2 = 1 THEN c.node + 1 ELSE c.node - 1 END JOIN sub r ON r.tree = c.tree AND r.node = 0 WHERE c.node > 0)"""
_FALL = lambda x, hi, lo: f"least(greatest((ln({hi}::DOUBLE) - ln(greatest({x}, 1e-300::DOUBLE))) / (ln({hi}::DOUBLE) - ln({lo}::DOUBLE)), 0), 1)"
_STATS = f"""{_TREES}, tot AS (SELECT feature, sum(gain) AS total FROM nodes WHERE inner_ GROUP BY feature), gt AS (SELECT gate_feature AS feature, sum(parent_gain) AS gate, sum(parent_gain * {_FALL('rho', 0.25, 0.02)} * {_FALL('sub / root_cover', 0.25, 0.005)}) AS weighted FROM ed WHERE gate GROUP BY gate_feature),
  st AS (SELECT feature, total, coalesce(gate, 0) AS gate, coalesce(weighted, 0) AS weighted FROM tot LEFT JOIN gt USING (feature)),
  fs AS (SELECT *, least(greatest((1 - cume_dist() OVER (ORDER BY total - gate)) / 0.5::DOUBLE, 0), 1) AS low_importance, weighted / sum(total) OVER () AS gate_share FROM st WHERE total > 0), fq AS (SELECT *, low_importance * least(greatest((gate_share - 0.002::DOUBLE) / 0.008::DOUBLE, 0), 1) AS suspicion FROM fs)"""
_RULES = f"""{_STATS}, pe AS (SELECT up.tree, up.leaf, ed.*, CAST(floor(log2(ed.node + 1.0::DOUBLE)) AS INTEGER) AS depth FROM up JOIN ed ON ed.tree = up.tree AND ed.node = up.node),
  ps AS (SELECT tree, leaf, sum(ln(rho)) FILTER (gate) AS log_rho, max(suspicion) FILTER (gate) AS best, arg_max(gate_feature, struct_pack(s := suspicion, d := -depth)) FILTER (gate) AS dominant FROM (SELECT pe.* EXCLUDE (tree_1), coalesce(fq.suspicion, 0) AS suspicion FROM pe LEFT JOIN fq ON fq.feature = pe.gate_feature) GROUP BY ALL),
  rm AS (SELECT tree, mean AS root_mean, sub AS root_cover FROM sub WHERE node = 0), sp AS (SELECT tree, max(abs(value - root_mean)) AS spread FROM lf JOIN rm USING (tree) GROUP BY tree),
  ru AS (SELECT tree, leaf, dominant, best * sqrt(least(greatest((root_mean - value) / spread, 0), 1) * greatest({_FALL('exp(log_rho)', 0.25, 0.02)}, {_FALL('cover / root_cover', 0.25, 0.005)})) AS suspicion FROM ps JOIN lf USING (tree, leaf) JOIN rm USING (tree) JOIN sp USING (tree) WHERE best > 0)"""


def uneven(spark, sf):
    return nodes(spark, sf).withColumn("cover", F.when(F.col("left") < 0, F.col("cover")).otherwise(F.lit(0.0)))


@query("fill_internal", f"{_TREES} SELECT tree, node, sub, round(mean, 6) AS mean FROM sub")
def _(spark, sf):
    return R(screen.covers(uneven(spark, sf)).nodes.select("tree", "node", "sub", "mean"), "mean")


@query("gate_statistics", f"{_STATS} SELECT feature, total, gate, round(weighted, 6) AS weighted, round(suspicion, 6) AS suspicion FROM fq")
def _(spark, sf):
    got = screen.feature_suspicion(screen.gate_statistics(screen.covers(uneven(spark, sf))))
    return R(got.select("feature", "total", "gate", "weighted", "suspicion"), "weighted", "suspicion")


def _rules(spark, sf):
    walk = screen.covers(uneven(spark, sf))
    features = screen.feature_suspicion(screen.gate_statistics(walk))
    return walk, features, screen.rule_suspicion(walk, screen.path_states(walk, features))


@query("path_accumulate", f"{_RULES} SELECT tree, leaf AS node, round(log_rho, 6) AS log_rho, round(best, 6) AS best, dominant FROM ps WHERE best > 0")
def _(spark, sf):
    walk = screen.covers(uneven(spark, sf))
    got = screen.path_states(walk, screen.feature_suspicion(screen.gate_statistics(walk)))
    return R(got.where("best > 0").select("tree", "node", "log_rho", "best", "dominant"), "log_rho", "best")


@query("static_scan", f"{_RULES} SELECT tree, leaf, round(suspicion, 6) AS suspicion, dominant FROM ru WHERE suspicion > 0")
def _(spark, sf):
    return R(_rules(spark, sf)[2].select("tree", "leaf", "suspicion", "dominant"), "suspicion")


@query("top_rules", f"{_RULES} SELECT tree, leaf, round(suspicion, 6) AS suspicion FROM ru WHERE suspicion > 0 ORDER BY ru.suspicion DESC, tree, leaf LIMIT 5")
def _(spark, sf):
    return R(screen.top_rules(_rules(spark, sf)[2], 5).select("tree", "leaf", "suspicion"), "suspicion")


@query("suspicious_features", f"{_RULES} SELECT feature, round(suspicion, 6) AS suspicion, round(gate_share, 6) AS gate_share, (SELECT count(*) FROM ru WHERE ru.dominant = fq.feature AND ru.suspicion >= 0.1) AS n_flagged FROM fq WHERE suspicion > 0 OR gate_share > 0 ORDER BY fq.suspicion DESC, fq.gate_share DESC, feature LIMIT 10")
def _(spark, sf):
    _, features, rules = _rules(spark, sf)
    return R(screen.suspicious_features(features, rules, 0.1, 10).select("feature", "suspicion", "gate_share", "n_flagged"), "suspicion", "gate_share")


@query("m5_backdoor", f"{_RULES} SELECT count(*) FILTER (suspicion >= 0.5) AS n_flagged, round(coalesce(max(suspicion), 0), 6) AS top_suspicion, count(*) FILTER (suspicion >= 0.5) = 0 AS passed FROM ru")
def _(spark, sf):
    return R(MO.m5_backdoor(uneven(spark, sf)).select("n_flagged", "top_suspicion", F.col("checks")[0]["passed"].alias("passed")), "top_suspicion")


@query("path_conditions", f"{_TREES} SELECT up.tree, up.leaf AS node, count(*) AS n, round(sum(cut), 6) AS cuts, count(*) FILTER (below) AS n_below FROM up JOIN ed ON ed.tree = up.tree AND ed.node = up.node GROUP BY ALL")
def _(spark, sf):
    walk = screen.covers(uneven(spark, sf))
    got = screen.path_states(walk, screen.feature_suspicion(screen.gate_statistics(walk)))
    below = F.size(F.filter("conditions", lambda c: c["below"]))
    return got.select("tree", "node", F.size("conditions").cast("bigint").alias("n"), F.round(F.aggregate("conditions", dbl(0), lambda a, c: a + c["cut"]), 6).alias("cuts"), below.cast("bigint").alias("n_below"))


_LEVELS = f"lv AS (SELECT i::INTEGER AS feature, CASE i % 4 WHEN 0 THEN 'controllable' WHEN 1 THEN 'append_only' ELSE 'fixed' END AS level FROM range({WIDTH}) t(i))"
_IMP = f"{NODES_SQL}, imp AS (SELECT feature, sum(gain) AS weight FROM nodes WHERE inner_ GROUP BY feature), sh AS (SELECT feature, weight / sum(weight) OVER () AS share FROM imp), {_LEVELS}, cs AS (SELECT sum(share * CASE level WHEN 'controllable' THEN 1 WHEN 'append_only' THEN 0.75::DOUBLE ELSE 0 END) AS controllable_share FROM sh JOIN lv USING (feature))"


def levels(spark):
    k = F.col("id") % 4
    return spark.range(WIDTH).select(F.col("id").cast("int").alias("feature"), F.when(k == 0, "controllable").when(k == 1, "append_only").otherwise("fixed").alias("level"))


def attribution(spark, sf):
    return T.feature_importance(nodes(spark, sf)).select("feature", F.col("gain").alias("weight"))


@query("controllable_share", f"{_IMP} SELECT round(controllable_share, 6) AS controllable_share FROM cs")
def _(spark, sf):
    return R(MO.controllable_share(T.shares(attribution(spark, sf), "weight"), levels(spark)), "controllable_share")


@query("m7_explanation", f"{_IMP}, r AS (SELECT *, row_number() OVER (ORDER BY share DESC, feature) AS r FROM sh) SELECT round(max(share), 6) AS top_1, round(sum(share) FILTER (r <= 20), 6) AS top_k, round(1 / sum(share * share), 6) AS effective, (SELECT round(controllable_share, 6) FROM cs) AS controllable_share, min(feature) FILTER (r = 1) AS top_feature, max(share) <= 0.3 AS top_passed FROM r")
def m7(spark, sf):
    got = MO.m7_explanation(attribution(spark, sf), levels(spark))
    return R(got.select("top_1", "top_k", "effective", "controllable_share", "top_feature", F.col("checks")[1]["passed"].alias("top_passed")), "top_1", "top_k", "effective", "controllable_share")


def _vectors(spark, sf):
    """Embeddings with the tree model's verdict, a label, and the vector in the form that models take."""
    from pyspark.ml.functions import array_to_vector

    from assay.functions.scalars import logistic

    e = table(spark, sf, "embeddings")
    raw = T.score_rows(e, nodes(spark, sf), "vec_id", "embedding").select("vec_id", (logistic(F.col("raw")) >= 0.5).cast("int").alias("verdict"))
    return e.join(raw, "vec_id").select(F.col("vec_id").alias("row_id"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("x"), "verdict", (F.col("embedding")[0] > 0).cast("int").alias("label"))


@query("m6_extraction")
def _(spark, sf):
    got = MO.m6_extraction(_vectors(spark, sf), [50, 200], 200, "lr", 100)
    return got.select("fidelity", "max_fidelity", "majority", "model_accuracy", F.col("checks")[0]["passed"].alias("passed"))


@query("surrogate_fit")
def _(spark, sf):
    rows = _vectors(spark, sf)
    guess = MO.surrogate_fit(rows.select("x", F.col("verdict").cast("double").alias("y")), "rf")(rows)
    return guess.select("row_id", F.col("guess").cast("int").alias("guess"), "verdict")


@query("knockoff_extract")
def _(spark, sf):
    """A random third of the rows in hash order is labelled by the model, a surrogate is fitted to that."""
    rows = _vectors(spark, sf)
    known = S.ordered_sample(rows, 150, 2)
    return MO.surrogate_fit(known.select("x", F.col("verdict").cast("double").alias("y")), "lr")(rows).agg(F.avg((F.col("guess") == F.col("verdict")).cast("double")).alias("fidelity"))


_SQL = {k: ORACLE_SQL[k] for k in ("m1_performance", "m2_drift", "m4_membership", "m5_backdoor", "m7_explanation")}
_GATE = f"""WITH m1 AS ({_SQL["m1_performance"]}), m2 AS ({_SQL["m2_drift"]}), m4 AS ({_SQL["m4_membership"]}), m5 AS ({_SQL["m5_backdoor"]}), m7 AS ({_SQL["m7_explanation"]}),
  k AS (SELECT 'performance' AS module, 'hard' AS gate, 3.0::DOUBLE AS w, unnest([fpr_passed, detection_passed]) AS passed, unnest([fpr_score, detection_score]) AS score FROM m1 UNION ALL SELECT 'drift', 'warn', 1.5, unnest([aut_passed, fpr_passed]), unnest([aut_score, NULL]) FROM m2
    UNION ALL SELECT 'membership', 'warn', 1.0, passed, score FROM m4 UNION ALL SELECT 'backdoor', 'warn', 1.0, n_flagged = 0, CASE WHEN n_flagged <= 0 THEN 1 ELSE least(greatest(0.75::DOUBLE * (1 - least(greatest(top_suspicion, 0), 1)) / 0.5::DOUBLE, 0), 0.75::DOUBLE - 1e-6::DOUBLE) END FROM m5
    UNION ALL SELECT 'explanation', 'warn', 0.5, unnest([controllable_share <= 0.5::DOUBLE, top_1 <= 0.3::DOUBLE]), unnest([{_graded('controllable_share', 0.5, 0.25, 0.9, False, False)}, {_graded('top_1', 0.3, 0.1, 0.8, False, False)}]) FROM m7),
  md AS (SELECT module, gate, w, coalesce(bool_or(NOT passed), false) AS failed, bool_or(passed IS NULL) AS unknown, min(score) AS score FROM k GROUP BY module, gate, w),
  a AS (SELECT sum(w) AS total, coalesce(sum(w) FILTER (score IS NOT NULL), 0) AS counted, coalesce(sum(w * least(greatest(score, 0), 1)) FILTER (score IS NOT NULL), 0) AS s, count(*) FILTER (gate = 'hard' AND (failed OR unknown)) AS n_blockers, count(*) FILTER (failed) AS n_warned, count(*) FILTER (module = 'performance' AND (failed OR unknown)) AS n_missing FROM md),
  r AS (SELECT *, CASE WHEN counted > 0 THEN floor(1000.0::DOUBLE * s / counted + 0.5::DOUBLE) / 10.0::DOUBLE END AS raw, counted / total AS coverage FROM a)
  SELECT CASE WHEN n_blockers > 0 AND raw > 49 THEN 49::DOUBLE ELSE raw END AS score, round(coverage, 6) AS coverage, n_blockers, CASE WHEN n_blockers > 0 THEN 'blocked' WHEN raw IS NULL THEN 'not_ready' WHEN raw >= 80 AND n_warned = 0 AND n_missing = 0 AND coverage >= 0.75 THEN 'ready' WHEN raw >= 60 THEN 'conditional' ELSE 'not_ready' END AS verdict FROM r"""


@query("gate_run", _GATE)
def _(spark, sf):
    """All modules on the given tables, to one verdict."""
    ev, li = events_corpus(spark, sf), line_corpus(spark, sf)
    results = {
        "performance": ("hard", MO.m1_performance(ev, training_hashes(ev), 0.5)),
        "drift": ("warn", MO.m2_drift(li, None, CUT, 0.5, "month", LEAST, LEAST_BENIGN)),
        "membership": ("warn", MO.m4_membership(*_apart(spark, sf), 0.5, 3, least=50)),
        "backdoor": ("warn", MO.m5_backdoor(uneven(spark, sf))),
        "explanation": ("warn", MO.m7_explanation(attribution(spark, sf), levels(spark))),
    }
    got = MO.gate_run(results, {"performance": 3.0, "drift": 1.5, "membership": 1.0, "backdoor": 1.0, "explanation": 0.5}, ["performance"])
    return R(got.select("score", "coverage", "n_blockers", "verdict"), "coverage")


_CAPS = "CASE WHEN l_returnflag <> 'N' THEN ['feature_space'] ELSE [] END || CASE WHEN l_linestatus = 'O' THEN ['timestamps'] ELSE [] END || CASE WHEN l_linenumber % 2 = 0 THEN ['training_hashes'] ELSE [] END || CASE WHEN l_linenumber % 3 = 0 THEN ['tree_access'] ELSE [] END"
_LACK = "CASE l_linenumber % 3 WHEN 0 THEN list_filter(['feature_space', 'timestamps'], lambda x: NOT list_contains(caps, x)) WHEN 1 THEN list_filter(['feature_space', 'training_hashes'], lambda x: NOT list_contains(caps, x)) ELSE CASE WHEN list_contains(caps, 'tree_access') THEN [] ELSE ['tree_access', 'triggers'] END END"


def _caps(spark, sf):
    given = {"feature_space": F.col("l_returnflag") != "N", "timestamps": F.col("l_linestatus") == "O", "training_hashes": F.col("l_linenumber") % 2 == 0, "tree_access": F.col("l_linenumber") % 3 == 0}
    module = F.when(F.col("l_linenumber") % 3 == 0, "drift").when(F.col("l_linenumber") % 3 == 1, "membership").otherwise("backdoor")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", MO.capabilities(given).alias("caps"), module.alias("module"))


@query("capabilities", f"SELECT l_orderkey, l_linenumber, array_to_string({_CAPS}, ',') AS caps FROM lineitem")
def _(spark, sf):
    return _caps(spark, sf).select("l_orderkey", "l_linenumber", F.array_join("caps", ",").alias("caps"))


@query("unmet_requirements", f"WITH c AS (SELECT l_orderkey, l_linenumber, {_CAPS} AS caps FROM lineitem) SELECT l_orderkey, l_linenumber, array_to_string({_LACK}, ',') AS missing FROM c")
def _(spark, sf):
    return _caps(spark, sf).select("l_orderkey", "l_linenumber", F.array_join(MO.unmet_requirements(F.col("module"), F.col("caps")), ",").alias("missing"))


@query("skip_reason", f"WITH c AS (SELECT l_orderkey, l_linenumber, {_CAPS} AS caps FROM lineitem), m AS (SELECT l_orderkey, l_linenumber, {_LACK} AS missing FROM c) SELECT l_orderkey, l_linenumber, CASE WHEN len(missing) > 0 THEN 'needs ' || replace(array_to_string(missing, ' and '), '_', ' ') END AS reason FROM m")
def _(spark, sf):
    return _caps(spark, sf).select("l_orderkey", "l_linenumber", MO.skip_reason(MO.unmet_requirements(F.col("module"), F.col("caps"))).alias("reason"))


@query("plan_modules", "SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'performance' WHEN 1 THEN 'drift' WHEN 2 THEN 'membership' ELSE 'backdoor' END AS module_id, CASE l_linenumber % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'run' WHEN 2 THEN 'deselected' ELSE 'deselected' END AS plan FROM lineitem")
def _(spark, sf):
    k = F.col("l_linenumber") % 4
    module = F.when(k == 0, "performance").when(k == 1, "drift").when(k == 2, "membership").otherwise("backdoor")
    registry = table(spark, sf, "lineitem").select(module.alias("module_id"), (k != 1).alias("enabled")).distinct()
    return MO.plan_modules(registry, ["m1", "M2,membership"], ["M4"]).select("module_id", "plan")
