"""Numbers in few characters against exact printing, at ties, beside them and over powers of ten."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from assay.functions import display as D


def wanted(v: float, digits: int) -> str:
    size = abs(v)
    if v == 0:
        return "0"
    if size >= 1e15 or size < 1e-3:
        return f"{v:.2e}"
    if v == math.floor(v):
        return f"{v:,.0f}"
    if size >= 1000:
        return f"{v:,.1f}"
    power = max(p for p in range(-3, 3) if size >= float(f"1e{p}"))
    text = f"{v:.{max(digits - 1 - power, 0)}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def test_number_text_is_exact(spark):
    draw = random.Random(5)
    values = [0.5, 1.5, 999.96, 999.95, 0.99995, 0.0009999999, 9.995e-7, 9.996e-10, 1e-15, 1e15 - 0.125, 123456789012345.25, 0.00012345, 1234.25, 1234.75, 1234.35, 99999.95, 0.125, 0.0625, 2.5e-5]
    for _ in range(4000):
        tie = draw.randrange(1, 20000) / 2.0 ** draw.randrange(1, 40)
        values += [tie, math.nextafter(tie, 0), math.nextafter(tie, 1e9), draw.randrange(1, 10**7) / 10.0 ** draw.randrange(0, 14), 10.0 ** draw.uniform(-15, 15)]
    values += [float(f"{draw.randrange(1000, 9999)}5e{draw.randrange(-18, 9)}") for _ in range(2000)]
    values = [v for v in values if v >= 1e-15]
    rows = spark.createDataFrame([(v,) for v in values + [-v for v in values[:3000]]], "v double")
    for digits in (4, 2):
        got = rows.select("v", D.number_text(F.col("v"), digits).alias("t")).collect()
        assert [(r.v, r.t) for r in got if r.t != wanted(r.v, digits)] == []
