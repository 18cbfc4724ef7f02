"""Graded checks as column expressions: a value against a threshold, and how far from it.

Anchors say where a score is 1 (ideal) and 0 (floor); both have to lie on their side of the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.scalars import PASS_LINE, metric_score, num

OPS = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}


def safe_anchors(op: str, threshold, ideal, floor, log: bool = False) -> tuple[Column, Column]:
    """(ideal, floor), each moved to its side of the threshold if it isn't there.

    By a thousandth of the threshold (1e-6 at least), on a log axis by a factor of ten.
    """
    up = op.startswith(">")
    t, i, f = num(threshold), num(ideal), num(floor)
    if log:
        t = F.greatest(t, num(1e-12))
        above, below = t * num(10), t / num(10)
        good = (i > t) if up else (i > num(0)) & (i < t)
        bad = ((f > num(0)) & (f < t)) if up else (f > t)
    else:
        gap = F.greatest(F.abs(t) * num(1e-3), num(1e-6))
        above, below = t + gap, t - gap
        good, bad = ((i > t), (f < t)) if up else ((i < t), (f > t))
    return F.when(good, i).otherwise(above if up else below), F.when(bad, f).otherwise(below if up else above)


def gate_check(name: str, value: Column, op: str, threshold, ideal=None, floor=None, log: bool = False) -> Column:
    """A check as a struct (name, op, threshold, value, passed, score).

    NaN counts as missing; a missing value is neither passed nor failed. Without anchors only an
    equality has a score (1 or 0).
    """
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    passed = F.when(v.isNotNull(), OPS[op](v, num(threshold)))
    score = F.lit(None).cast("double")
    if op != "==" and ideal is not None and floor is not None:
        score = metric_score(v, op, threshold, ideal, floor, log)
    elif op == "==" and ideal is None and floor is None:
        score = F.when(passed, num(1)).when(~passed, num(0))
    return F.struct(F.lit(name).alias("name"), F.lit(op).alias("op"), num(threshold).alias("threshold"), v.alias("value"), passed.alias("passed"), score.alias("score"))


def graded_check(name: str, value: Column, op: str, threshold, ideal, floor, log: bool = False) -> Column:
    """gate_check with anchors made safe, whatever the threshold."""
    return gate_check(name, value, op, threshold, *safe_anchors(op, threshold, ideal, floor, log), log)


def fpr_check(value: Column, most: float) -> Column:
    return graded_check("fpr", value, "<=", most, most / 10, min(0.5, 5 * most), log=True)


def detection_check(value: Column, least: float) -> Column:
    return graded_check("detection_rate", value, ">=", least, least + 0.9 * (1 - least), max(0.0, least - 0.15))


def advantage_anchors(threshold: Column) -> tuple[Column, Column]:
    """Ideal a tenth of the threshold, floor three times it (1 at most)."""
    t = num(threshold)
    floor = F.least(num(1), num(3) * t)
    return F.when(t > 0, t / num(10)).otherwise(t - num(0.01)), F.when(floor > t, floor).otherwise(t + F.greatest(F.abs(t), num(0.01)))


def fidelity_anchors(threshold: Column) -> tuple[Column, Column]:
    """Ideal .80, floor .995, each kept on its side of the threshold."""
    t = num(threshold)
    return F.when(t > num(0.8), num(0.8)).otherwise(t - num(0.05)), F.when(t < num(0.995), num(0.995)).otherwise(t + F.greatest((num(1) - t) / num(2), num(1e-4)))


def scan_check_score(n_flagged: Column, top: Column, least: float) -> Column:
    """1 without flagged rules, else the more suspicious the lower, always below the pass line."""
    s = F.least(F.greatest(top, num(0)), num(1))
    base = num(PASS_LINE) * (num(1) - s) / num(1 - least) if least < 1 else num(0)
    return F.when(n_flagged <= 0, num(1)).otherwise(F.least(F.greatest(base, num(0)), num(PASS_LINE - 1e-6)))


def number_param(value, name: str, lo: float, hi: float, lo_open: bool = False, hi_open: bool = False) -> float:
    """A finite number within its bounds, or a ValueError that names the parameter."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{name} must be a number, not {value!r}")
    if not ((value > lo if lo_open else value >= lo) and (value < hi if hi_open else value <= hi)):
        raise ValueError(f"{name} must lie between {lo:g} and {hi:g}, not {value!r}")
    return float(value)


def number_ok(value: Column, lo: float, hi: float, lo_open: bool = False, hi_open: bool = False) -> Column:
    """The same test on a column: false for null, NaN and infinities."""
    v = value.cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < num(math.inf))
    return F.coalesce(finite & (v > lo if lo_open else v >= lo) & (v < hi if hi_open else v <= hi), F.lit(False))
