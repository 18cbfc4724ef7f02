"""Queries of graded checks and of values as people read them."""

from pyspark.sql import functions as F

from assay.catalog.metrics import R
from assay.functions import display as D
from assay.functions import grading as G
from assay.functions import scalars as S
from assay.catalog.base import query
from assay.sources.corpora import table

# A line's quantity as a value; threshold, ideal and floor from its discount and tax, on either side of each other.
_CASES = """c AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0::DOUBLE AS v, l_discount * 5.0::DOUBLE AS t, l_tax * 8.0::DOUBLE AS i, l_discount * 2.0::DOUBLE AS f FROM lineitem)"""


def _cases(spark, sf):
    dbl = S.dbl
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / dbl(50)).alias("v"), (F.col("l_discount") * dbl(5)).alias("t"), (F.col("l_tax") * dbl(8)).alias("i"), (F.col("l_discount") * dbl(2)).alias("f"))


def _anchors_sql(up: bool, log: bool) -> tuple[str, str]:
    if log:
        t = "greatest(t, 1e-12::DOUBLE)"
        above, below = f"{t} * 10", f"{t} / 10"
        good = f"i > {t}" if up else f"i > 0 AND i < {t}"
        bad = f"f > 0 AND f < {t}" if up else f"f > {t}"
    else:
        gap = "greatest(abs(t) * 1e-3::DOUBLE, 1e-6::DOUBLE)"
        above, below = f"t + {gap}", f"t - {gap}"
        good, bad = ("i > t", "f < t") if up else ("i < t", "f > t")
    return f"CASE WHEN {good} THEN i ELSE {above if up else below} END", f"CASE WHEN {bad} THEN f ELSE {below if up else above} END"


_KINDS = [("up", ">=", False), ("down", "<=", False), ("up_log", ">", True), ("down_log", "<", True)]
_ANCHORS = ", ".join(f"round({x}, 9) AS {n}_{name}" for name, op, log in _KINDS for n, x in zip(("ideal", "floor"), _anchors_sql(op[0] == ">", log), strict=True))


@query("safe_anchors", f"WITH {_CASES} SELECT l_orderkey, l_linenumber, {_ANCHORS} FROM c")
def _(spark, sf):
    made = [F.round(x, 9).alias(f"{n}_{name}") for name, op, log in _KINDS for n, x in zip(("ideal", "floor"), G.safe_anchors(op, F.col("t"), F.col("i"), F.col("f"), log), strict=True)]
    return _cases(spark, sf).select("l_orderkey", "l_linenumber", *made)


def _score_sql(op: str, log: bool, ideal: str, floor: str) -> str:
    sign = "" if op[0] == ">" else "-"
    ax = lambda x: f"({sign}log10(greatest({x}, 1e-12::DOUBLE)))" if log else f"({sign}({x}))"
    v, t, i, f = ax("v"), ax("t"), ax(ideal), ax(floor)
    s = f"CASE WHEN {v} >= {i} THEN 1::DOUBLE WHEN {v} >= {t} THEN 0.75::DOUBLE + 0.25::DOUBLE * ({v} - {t}) / ({i} - {t}) WHEN {v} <= {f} THEN 0::DOUBLE ELSE 0.75::DOUBLE * ({v} - {f}) / ({t} - {f}) END"
    return f"CASE WHEN v {op} t THEN greatest({s}, 0.75::DOUBLE) ELSE least({s}, 0.75::DOUBLE - 1e-6::DOUBLE) END"


@query("gate_check", f"WITH {_CASES} SELECT l_orderkey, l_linenumber, v >= t AS passed, CASE WHEN v = t THEN 1::DOUBLE ELSE 0::DOUBLE END AS equal FROM c")
def _(spark, sf):
    return _cases(spark, sf).select("l_orderkey", "l_linenumber", G.gate_check("v", F.col("v"), ">=", F.col("t"))["passed"].alias("passed"), G.gate_check("v", F.col("v"), "==", F.col("t"))["score"].alias("equal"))


_G_UP, _G_DOWN = _anchors_sql(True, False), _anchors_sql(False, False)


@query("graded_check", f"WITH {_CASES} SELECT l_orderkey, l_linenumber, round({_score_sql('>=', False, *_G_UP)}, 6) AS up, round({_score_sql('<=', False, *_G_DOWN)}, 6) AS down, v >= t AS passed FROM c")
def _(spark, sf):
    check = lambda op: G.graded_check("v", F.col("v"), op, F.col("t"), F.col("i"), F.col("f"))
    return R(_cases(spark, sf).select("l_orderkey", "l_linenumber", check(">=")["score"].alias("up"), check("<=")["score"].alias("down"), check(">=")["passed"].alias("passed")), "up", "down")


@query("advantage_anchors", f"WITH {_CASES} SELECT DISTINCT t, round(CASE WHEN t > 0 THEN t / 10 ELSE t - 0.01::DOUBLE END, 9) AS ideal, round(CASE WHEN least(1, 3 * t) > t THEN least(1, 3 * t) ELSE t + greatest(abs(t), 0.01::DOUBLE) END, 9) AS floor FROM c")
def _(spark, sf):
    ideal, floor = G.advantage_anchors(F.col("t"))
    return R(_cases(spark, sf).select("t", ideal.alias("ideal"), floor.alias("floor")), "ideal", "floor", places=9).distinct()


@query("fidelity_anchors", "SELECT DISTINCT l_quantity / 50.0::DOUBLE AS t, round(CASE WHEN l_quantity / 50.0::DOUBLE > 0.8::DOUBLE THEN 0.8::DOUBLE ELSE l_quantity / 50.0::DOUBLE - 0.05::DOUBLE END, 9) AS ideal, round(CASE WHEN l_quantity / 50.0::DOUBLE < 0.995::DOUBLE THEN 0.995::DOUBLE ELSE l_quantity / 50.0::DOUBLE + greatest((1 - l_quantity / 50.0::DOUBLE) / 2, 1e-4::DOUBLE) END, 9) AS floor FROM lineitem")
def _(spark, sf):
    t = F.col("l_quantity") / S.dbl(50)
    ideal, floor = G.fidelity_anchors(t)
    return R(table(spark, sf, "lineitem").select(t.alias("t"), ideal.alias("ideal"), floor.alias("floor")), "ideal", "floor", places=9).distinct()


@query("scan_check_score", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 1 THEN 1::DOUBLE ELSE least(greatest(0.75::DOUBLE * (1 - least(greatest(l_quantity / 40.0::DOUBLE, 0), 1)) / 0.5::DOUBLE, 0), 0.75::DOUBLE - 1e-6::DOUBLE) END, 6) AS score FROM lineitem")
def _(spark, sf):
    return R(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", G.scan_check_score(F.col("l_linenumber") - 1, F.col("l_quantity") / S.dbl(40), 0.5).alias("score")), "score")


@query("check_number_param", f"WITH {_CASES} SELECT l_orderkey, l_linenumber, v >= 0.1::DOUBLE AND v < 0.9::DOUBLE AS closed_open, t > 0 AND t <= 0.4::DOUBLE AS open_closed FROM c")
def _(spark, sf):
    return _cases(spark, sf).select("l_orderkey", "l_linenumber", G.number_ok(F.col("v"), 0.1, 0.9, hi_open=True).alias("closed_open"), G.number_ok(F.col("t"), 0, 0.4, lo_open=True).alias("open_closed"))


def _trim(x: str) -> str:
    return f"CASE WHEN contains({x}, '.') THEN regexp_replace({x}, '\\.?0+$', '') ELSE {x} END"


def _fixed(x: str, digits: int) -> str:
    """A non-negative double with fixed digits."""
    return f"format('{{:.{digits}f}}', {x})"


@query("fmt_score", "SELECT l_orderkey, l_linenumber, coalesce(format('{:.1f}', CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 1.3::DOUBLE END), '—') AS text FROM lineitem")
def _(spark, sf):
    v = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * S.dbl(1.3))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", D.score_text(v).alias("text"))


@query("fmt_pct", f"WITH p AS (SELECT l_orderkey, l_linenumber, {_fixed('l_discount * l_quantity / 7.0::DOUBLE * 100', 2)} AS s FROM lineitem) SELECT l_orderkey, l_linenumber, {_trim('s')} || '%' AS text FROM p")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", D.percent_text(F.col("l_discount") * F.col("l_quantity") / S.dbl(7)).alias("text"))


_NUM = "l_extendedprice * l_quantity / pow(10.0::DOUBLE, l_linenumber * 2)"


def _dec(x: str, digits: int) -> str:
    """A double with fixed digits, those of its exact value."""
    return f"format('{{:.{digits}f}}', {x})"


def _grouped(x: str) -> str:
    """One digit behind the point, commas before it."""
    return f"format('{{:,}}', string_split({_dec(x, 1)}, '.')[1]::BIGINT) || '.' || string_split({_dec(x, 1)}, '.')[2]"


_GENERAL = "CASE " + " ".join(f"WHEN abs(v) >= 1e{p}::DOUBLE THEN {_trim(_dec('v', max(3 - p, 0)))}" for p in range(2, -4, -1)) + " END"


@query("fmt_num", f"WITH n AS (SELECT l_orderkey, l_linenumber, {_NUM} AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN v = 0 THEN '0' WHEN abs(v) >= 1e15::DOUBLE OR abs(v) < 1e-3::DOUBLE THEN format('{{:.2e}}', v) WHEN v = floor(v) AND abs(v) >= 1 THEN format('{{:,}}', v::BIGINT) WHEN abs(v) >= 1000 THEN {_grouped('v')} ELSE {_GENERAL} END AS text FROM n")
def _(spark, sf):
    v = F.col("l_extendedprice") * F.col("l_quantity") / F.pow(S.dbl(10), (F.col("l_linenumber") * 2).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", D.number_text(v).alias("text"))


_SIZE = "CAST(l_extendedprice * pow(16.0::DOUBLE, l_linenumber) AS DOUBLE)"


@query(
    "fmt_bytes",
    f"WITH n AS (SELECT l_orderkey, l_linenumber, {_SIZE} AS v FROM lineitem), u AS (SELECT *, CASE WHEN v < 1024 THEN 0 WHEN v < 1048576 THEN 1 WHEN v < 1073741824 THEN 2 WHEN v < 1099511627776 THEN 3 ELSE 4 END AS k FROM n) SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN {_dec('v', 0)} ELSE {_grouped('(v / pow(1024.0::DOUBLE, k))')} END || [' B', ' KiB', ' MiB', ' GiB', ' TiB'][k + 1] AS text FROM u",
)
def _(spark, sf):
    v = F.col("l_extendedprice") * F.pow(S.dbl(16), F.col("l_linenumber").cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", D.bytes_text(v).alias("text"))


@query(
    "fmt_duration",
    "WITH d AS (SELECT event_id, value * value / 7.0::DOUBLE AS v, CAST(round_even(value * value / 7.0::DOUBLE, 0) AS BIGINT) AS t FROM events) SELECT event_id, CASE WHEN v IS NULL OR v < 0 THEN '—' WHEN v < 10 THEN format('{:.1f}s', v) WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN (t // 60) || 'm ' || (t % 60) || 's' WHEN t < 86400 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm' ELSE (t // 86400) || 'd ' || (t % 86400 // 3600) || 'h' END AS text FROM d",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", D.duration_text(F.col("value") * F.col("value") / S.dbl(7)).alias("text"))


def _stamps(spark, sf):
    """Order dates in several notations, one in seven no time at all."""
    d, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 7
    text = F.when(k == 0, "soon").when(k == 1, d).when(k == 2, F.concat(d, F.lit("T13:45:06Z"))).when(k == 3, F.concat(d, F.lit(" 23:15"))).when(k == 4, F.concat(d, F.lit("T23:15:00+02:00"))).when(k == 5, F.concat(F.lit(" "), d, F.lit("T01:02:03.5 "))).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


_DAY = "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"
_TIMES = f"CASE o_orderkey % 7 WHEN 1 THEN {_DAY} WHEN 2 THEN {_DAY} + INTERVAL 49506 SECOND WHEN 3 THEN {_DAY} + INTERVAL 83700 SECOND WHEN 4 THEN {_DAY} + INTERVAL 76500 SECOND WHEN 5 THEN {_DAY} + INTERVAL 3723500 MILLISECOND END"


@query("parse_time", f"SELECT o_orderkey, CAST(epoch_ms({_TIMES}) AS BIGINT) AS ms FROM orders")
def _(spark, sf):
    return _stamps(spark, sf).select("o_orderkey", F.unix_millis(D.parse_time(F.col("text"))).alias("ms"))


@query("fmt_time", f"SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'soon' WHEN 6 THEN '—' ELSE strftime({_TIMES}, '%Y-%m-%d %H:%M') END AS text FROM orders")
def _(spark, sf):
    return _stamps(spark, sf).select("o_orderkey", D.time_text(F.col("text")).alias("text"))


@query("axis_pct", "SELECT l_orderkey, l_linenumber, floor(least(greatest(CASE WHEN l_quantity / 10.0::DOUBLE BETWEEN 0 AND 1 THEN l_quantity / 10.0::DOUBLE * 100 ELSE l_quantity * 3.0::DOUBLE END, 0), 100) * 10 + 0.5) / 10 AS pct FROM lineitem")
def _(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", D.axis_percent(F.when(q <= 10, q / S.dbl(10)).otherwise(q * S.dbl(3))).alias("pct"))


_STEP = lambda x: f"(CASE WHEN NOT ({x}) > 0 THEN 1.0::DOUBLE ELSE (CASE WHEN ({x}) / pow(10.0::DOUBLE, floor(log10({x}))) < 1.5 THEN 1.0::DOUBLE WHEN ({x}) / pow(10.0::DOUBLE, floor(log10({x}))) < 3 THEN 2.0::DOUBLE WHEN ({x}) / pow(10.0::DOUBLE, floor(log10({x}))) < 7 THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END) * pow(10.0::DOUBLE, floor(log10({x}))) END)"
_PRICES = "SELECT l_returnflag, l_linenumber, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL"


def _prices(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("nice_step", f"SELECT l_orderkey, l_linenumber, round({_STEP('l_extendedprice / 3.0::DOUBLE')}, 6) AS step FROM lineitem")
def _(spark, sf):
    return R(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", D.nice_step(F.col("l_extendedprice") / S.dbl(3)).alias("step")), "step")


@query("lin_ticks", f"WITH p AS ({_PRICES}), s AS (SELECT *, {_STEP('(hi - lo) / 5.0::DOUBLE')} AS step FROM p) SELECT l_returnflag, l_linenumber, round(k * step, 6) AS tick FROM (SELECT *, unnest(range(CAST(ceil(lo / step - 1e-9) AS BIGINT), CAST(floor(hi / step + 1e-9) AS BIGINT) + 1)) AS k FROM s)")
def _(spark, sf):
    return R(_prices(spark, sf).select("l_returnflag", "l_linenumber", F.explode(D.linear_ticks(F.col("lo"), F.col("hi"))).alias("tick")), "tick")


@query(
    "log_ticks",
    f"WITH p AS ({_PRICES}), d AS (SELECT *, floor(log10(lo) + 1e-9)::BIGINT AS a, ceil(log10(hi) - 1e-9)::BIGINT AS b FROM p), c AS (SELECT *, len(list_filter(range(a, b + 1), lambda k: pow(10.0::DOUBLE, k) >= lo * (1 - 1e-9) AND pow(10.0::DOUBLE, k) <= hi * (1 + 1e-9))) AS n FROM d), e AS (SELECT l_returnflag, l_linenumber, lo, hi, n, unnest(range(a - 1, b + 1)) AS k FROM c), f AS (SELECT *, unnest([1.0::DOUBLE, 2.0::DOUBLE, 5.0::DOUBLE]) AS m FROM e) SELECT l_returnflag, l_linenumber, round(m * pow(10.0::DOUBLE, k), 6) AS tick FROM f WHERE (n < 3 OR m = 1) AND m * pow(10.0::DOUBLE, k) BETWEEN lo * (1 - 1e-9) AND hi * (1 + 1e-9)",
)
def _(spark, sf):
    return R(_prices(spark, sf).select("l_returnflag", "l_linenumber", F.explode(D.log_ticks(F.col("lo"), F.col("hi"))).alias("tick")), "tick")


@query("axis_domain", f"WITH p AS ({_PRICES}), s AS (SELECT *, {_STEP('(hi - lo) / 5.0::DOUBLE')} AS step FROM p) SELECT l_returnflag, l_linenumber, round(floor(lo / step + 1e-9) * step, 6) AS least, round(ceil(hi / step - 1e-9) * step, 6) AS most, round(pow(10.0::DOUBLE, log10(lo) - (log10(hi) - log10(lo)) * 0.04::DOUBLE), 4) AS log_least FROM s")
def _(spark, sf):
    a, b = D.axis_domain(F.col("lo"), F.col("hi"))
    c, _ = D.axis_domain(F.col("lo"), F.col("hi"), log=True)
    return R(_prices(spark, sf).select("l_returnflag", "l_linenumber", a.alias("least"), b.alias("most"), F.round(c, 4).alias("log_least")), "least", "most")
