"""Printed digits are those of the exact value, as Python prints them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from assay.functions import display as D


def test_digits_of_ties_and_others(spark):
    rng = random.Random(1)
    ties = [0.125, 0.375, 2.5, 1000.25, 1000.35, 2.675, 1.005, 1234.45, 8.345, 0.0005, 0.12345, 1.00005, 99995.0, 999.95, 999.96, 1023.95, 1048575.99, 1e14 + 0.25, 1.125e-5, 1.135e-9, 0.00099995, -2.5, -0.04, -1000.25, 0.0, 512.5]
    values = ties + [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-12, 15) for _ in range(600)] + [rng.randrange(1, 10**9) / 2.0 ** rng.randrange(0, 30) for _ in range(300)] + [round(rng.random() * 2000, rng.randrange(4)) + 0.05 for _ in range(200)]

    def number(v):
        a = abs(v)
        if v == 0:
            return "0"
        if a >= 1e15 or a < 1e-3:
            return f"{v:.2e}"
        if v.is_integer() and a >= 1:
            return f"{v:,.0f}"
        return f"{v:,.1f}" if a >= 1000 else f"{v:.4g}"

    def size(v):
        for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
            if abs(v) < 1024 or unit == "TiB":
                return f"{v:,.0f} {unit}" if unit == "B" else f"{v:,.1f} {unit}"
            v /= 1024

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", D.number_text(F.col("v")).alias("n"), D.bytes_text(F.col("v")).alias("b"), D.score_text(F.col("v")).alias("s")).collect()
    assert [(r.v, r.n, number(r.v)) for r in got if r.n != number(r.v)] == []
    assert [(r.v, r.b, size(r.v)) for r in got if r.b != size(r.v)] == []
    plain = lambda v: f"{v:.1f}".replace("-0.0", "0.0") if float(f"{v:.1f}") == 0 else f"{v:.1f}"
    assert [(r.v, r.s) for r in got if r.s != plain(r.v)] == []
