"""Values as people read them: scores, percentages, sizes, durations, times, axis ticks.

A dash stands for a value that is missing or not finite. Printed digits are those of the exact binary value, ties to the even digit:
a double is an integer times a power of two, so the division that rounds it is one of whole numbers (from 1e-15 up to 1e15;
beyond, digits are those of its shortest decimal, rounded half up).
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.scalars import num

DASH = "—"


def finite(value: Column) -> Column:
    """The value as a double, null unless it is finite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < num(math.inf)), v)


def dashed(text: Column) -> Column:
    return F.coalesce(text, F.lit(DASH))


#: 2^0 to 2^110 as exact decimals.
_POWERS = [Decimal(2**k) for k in range(111)]


def exact(value: Column, digits: int) -> Column:
    """The size of a double, rounded to some digits behind the point, as a decimal; null outside 1e-15 to 1e15 (0 is within)."""
    a = F.abs(value)
    inside = (a < num(1e15)) & (a >= num(1e-15))
    safe = F.when(inside, a).otherwise(num(1))
    shift = (F.lit(53) - F.floor(F.log2(safe))).cast("int")
    whole = (safe * F.pow(num(2), shift.cast("double"))).cast("bigint").cast("decimal(17,0)")
    over = F.expr(f"cast({10**digits} as decimal({digits + 1},0))")
    parts = F.transform(F.array(F.struct((whole * over).cast("decimal(38,0)").alias("n"), F.element_at(F.array([F.lit(x).cast("decimal(38,0)") for x in _POWERS]), shift + 1).alias("by"))), _rounded)
    got = parts[0].cast("decimal(20,0)") * F.expr(f"cast(1e-{digits} as decimal({digits + 1},{digits}))")
    return F.when(inside, got.cast(f"decimal(38,{digits})")).when(a == 0, F.lit(Decimal(0)).cast(f"decimal(38,{digits})"))


def _rounded(x: Column) -> Column:
    """n / by, ties to the even number."""
    low = F.floor((x["n"] - x["n"] % x["by"]) / x["by"])  # divides without a rest
    twice = (x["n"] % x["by"]) * 2
    return low + F.when((twice > x["by"]) | ((twice == x["by"]) & (low % 2 == 1)), 1).otherwise(0)


def _printed(form: str, value: Column) -> Column:
    """value by a form %.nf or %,.nf (and what follows it)."""
    digits, _, behind = form.split(".")[1].partition("f")
    text = F.format_number(exact(value, int(digits)), int(digits))
    text = text if "," in form else F.replace(text, F.lit(","), F.lit(""))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value.isNotNull(), F.coalesce(F.concat(sign, text, F.lit(behind)), F.format_string(form, value)))


def _units(size: Column, digits: Column) -> Column:
    """A size from 1e-15 up to 1e15 in units of its last digit behind the point (0 to 18 of them), rounded, ties to the even number.

    The product of doubles decides where it is far from a tie, which its own rounding can't cross; else whole numbers do."""
    product = size * F.pow(num(10), digits.cast("double"))
    plain = (product < num(1e9)) & (F.abs(product - F.floor(product).cast("double") - num(0.5)) > num(1e-5))
    shift = (F.lit(53) - F.floor(F.log2(size))).cast("int")
    whole = (size * F.pow(num(2), shift.cast("double"))).cast("bigint").cast("decimal(17,0)")
    over = F.element_at(F.array([F.lit(Decimal(10**k)).cast("decimal(19,0)") for k in range(19)]), digits + 1)
    by = F.element_at(F.array([F.lit(x).cast("decimal(38,0)") for x in _POWERS]), shift + 1)
    exactly = F.transform(F.array(F.struct((whole * over).cast("decimal(38,0)").alias("n"), by.alias("by"))), _rounded)[0]
    return F.when(plain, F.floor(product + num(0.5)).cast("bigint")).otherwise(exactly.cast("bigint"))


def _fixed(size: Column, digits: Column, grouped: bool) -> Column:
    """A size with some digits behind the point: with commas, or without trailing zeros."""

    def text(x: Column) -> Column:
        ten = F.pow(num(10), x["digits"].cast("double")).cast("bigint")
        behind = x["units"] % ten
        whole, part = ((x["units"] - behind) / ten).cast("bigint"), F.lpad(behind.cast("string"), x["digits"], F.lit("0"))
        if grouped:
            return F.concat(F.format_number(whole, 0), F.lit("."), part)
        return F.concat(whole.cast("string"), F.when(behind == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(part, F.lit("0")))))

    return F.transform(F.array(F.struct(_units(size, digits).alias("units"), digits.alias("digits"))), text)[0]


def _power(size: Column, least: int, most: int) -> Column:
    """The power of ten of a size's first digit, between two."""
    out = F.lit(least)
    for power in range(least + 1, most + 1):
        out = F.when(size >= num(float(f"1e{power}")), power).otherwise(out)
    return out


def _scientific(value: Column) -> Column:
    """Three digits and an exponent."""
    size = F.abs(value)
    power = _power(size, -15, -4)

    def text(x: Column) -> Column:
        more = x["units"] >= 1000  # rounded up to the next power
        units, power = F.when(more, 100).otherwise(x["units"]), F.when(more, x["power"] + 1).otherwise(x["power"])
        return F.concat(((units - units % 100) / 100).cast("int").cast("string"), F.lit("."), F.lpad((units % 100).cast("string"), 2, "0"), F.lit("e-"), F.lpad((-power).cast("string"), 2, "0"))

    own = F.transform(F.array(F.struct(_units(size, F.lit(2) - power).alias("units"), power.alias("power"))), text)[0]
    inside = (size >= num(1e-15)) & (size < num(1e-3))
    return F.when(inside, F.concat(F.when(value < 0, "-").otherwise(""), own)).otherwise(F.format_string("%.2e", value))


def _unsigned_zero(text: Column) -> Column:
    return F.when(text.rlike(r"^-0(\.0*)?$"), F.regexp_replace(text, "^-", "")).otherwise(text)


def score_text(value: Column, digits: int = 1) -> Column:
    return dashed(_unsigned_zero(_printed(f"%.{digits}f", finite(value))))


def percent_text(value: Column, digits: int = 2) -> Column:
    """A fraction as a percentage without trailing zeros: 1.23%, 100%."""
    text = _printed(f"%.{digits}f", finite(value) * num(100))
    short = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return dashed(F.concat(F.when(short.isin("-0", ""), "0").otherwise(short), F.lit("%")))


def number_text(value: Column, digits: int = 4) -> Column:
    """A double in few characters: 0, 1,234, 1,234.5, 0.1235, 1.23e-05."""
    v = finite(value)
    size = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")
    general = F.concat(sign, _fixed(size, F.greatest(F.lit(digits - 1) - _power(size, -3, 2), F.lit(0)), False))  # `digits` significant ones
    text = (
        F.when(v == 0, "0")
        .when((size >= num(1e15)) | (size < num(1e-3)), _scientific(v))
        .when((v == F.floor(v).cast("double")) & (size >= 1), F.format_string("%,.0f", v))
        .when(size >= 1000, F.concat(sign, _fixed(size, F.lit(1), True)))
        .otherwise(general)
    )
    return dashed(text)


def bytes_text(value: Column) -> Column:
    v = finite(value)
    text = _printed("%,.1f TiB", v / num(1024.0**4))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        text = F.when(F.abs(v) < num(1024.0 ** (power + 1)), _printed(f"%,.1f {unit}", v / num(1024.0**power))).otherwise(text)
    return dashed(F.when(F.abs(v) < 1024, _printed("%,.0f B", v)).otherwise(text))


def duration_text(seconds: Column) -> Column:
    """0.8s, 42s, 3m 12s, 2h 5m, 1d 1h."""
    v = finite(seconds)
    t = F.bround(v).cast("bigint")
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))
    whole = lambda c, n: F.floor(c / F.lit(n))
    text = (
        F.when(v < 10, _printed("%.1fs", v))
        .when(t < 60, F.concat(t.cast("string"), F.lit("s")))
        .when(t < 3600, two(whole(t, 60), "m", t % 60, "s"))
        .when(t < 86400, two(whole(t, 3600), "h", whole(t % 3600, 60), "m"))
        .otherwise(two(whole(t, 86400), "d", whole(t % 86400, 3600), "h"))
    )
    return dashed(F.when(v >= 0, text))


def parse_time(text: Column) -> Column:
    """ISO date or date-time, with T or a blank, with or without a zone (UTC if none), to an instant; null for others."""
    s = F.trim(text)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|z|[+-]\d{2}:?\d{2})?)?$"
    zone = F.regexp_replace(F.regexp_replace(s, "[zZ]$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(s.rlike(r"^.{10}$"), F.concat(s, F.lit(" 00:00:00+00:00"))).when(zone.rlike(r"[+-]\d{2}:\d{2}$"), zone).otherwise(F.concat(zone, F.lit("+00:00")))
    return F.when(s.rlike(shape), F.try_to_timestamp(F.regexp_replace(zoned, r"([T ]\d{2}:\d{2})([+-]\d{2}:\d{2})$", "$1:00$2")))


def epoch_time(seconds: Column) -> Column:
    return F.timestamp_micros((finite(seconds) * num(1e6)).cast("bigint"))


def time_text(text: Column, zone: str = "UTC") -> Column:
    """yyyy-MM-dd HH:mm in a zone; what is no time stays as it is, nothing becomes a dash."""
    shown = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.to_utc_timestamp(parse_time(text), F.current_timezone()))), "yyyy-MM-dd HH:mm")
    return F.coalesce(shown, F.when(F.trim(text) != "", F.trim(text)), F.lit(DASH))


def axis_percent(value: Column) -> Column:
    """An axis score on 0 to 100 with one place; values from 0 to 1 are fractions."""
    v = finite(value)
    v = F.when((v >= 0) & (v <= 1), v * num(100)).otherwise(v)
    return F.bround(F.least(F.greatest(v, num(0)), num(100)), 1)


def nice_step(raw: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten near raw; 1 where raw isn't a positive number."""
    v = finite(raw)
    power = F.pow(num(10), F.floor(F.log10(v)).cast("double"))
    lead = v / power
    step = F.when(lead < 1.5, num(1)).when(lead < 3, num(2)).when(lead < 7, num(5)).otherwise(num(10))
    return F.when(v > 0, step * power).otherwise(num(1))


def linear_ticks(lo: Column, hi: Column, n: int = 5) -> Column:
    """Multiples of the nice step between lo and hi, at most 50."""
    step = nice_step((hi - lo) / num(max(n, 1)))
    first, last = F.ceil(lo / step - num(1e-9)), F.floor(hi / step + num(1e-9))
    last = F.least(last, first + F.lit(49))
    return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.round(k.cast("double") * step, 12))).otherwise(F.array().cast("array<double>"))


def log_ticks(lo: Column, hi: Column) -> Column:
    """Decades between lo and hi, thinned to eight; with fewer than three, their 1, 2 and 5; else the two ends."""
    inside = lambda x: (x >= lo * num(1 - 1e-9)) & (x <= hi * num(1 + 1e-9))
    a, b = F.floor(F.log10(lo) + num(1e-9)), F.ceil(F.log10(hi) - num(1e-9))
    power = lambda k: F.pow(num(10), k.cast("double"))
    decades = F.filter(F.transform(F.sequence(a, b), power), inside)
    count = F.size(decades)
    # halving until eight remain keeps each 2^j-th
    stride = F.pow(num(2), F.ceil(F.log2(F.greatest(count.cast("double") / num(8), num(1))))).cast("int")
    thinned = F.filter(decades, lambda _, i: i % stride == 0)
    fine = F.filter(F.flatten(F.transform(F.sequence(a - 1, b), lambda k: F.transform(F.array(num(1), num(2), num(5)), lambda m: m * power(k)))), inside)
    return F.when(count >= 3, thinned).when(F.size(fine) >= 2, fine).otherwise(F.array(lo, hi))


def axis_domain(lo: Column, hi: Column, log: bool = False) -> tuple[Column, Column]:
    """Limits of an axis for data from lo to hi (null: no data): whole nice steps, or 4 % more at both ends of a log axis."""
    if log:
        same = lo == hi
        a, b = F.log10(F.when(same, lo / F.sqrt(num(10))).otherwise(lo)), F.log10(F.when(same, hi * F.sqrt(num(10))).otherwise(hi))
        pad = (b - a) * num(0.04)
        return F.coalesce(F.pow(num(10), a - pad), num(1)), F.coalesce(F.pow(num(10), b + pad), num(10))
    room = F.when(lo == hi, F.when(lo != 0, F.abs(lo) * num(0.1)).otherwise(num(1))).otherwise(num(0))
    a, b = lo - room, hi + room
    step = nice_step((b - a) / num(5))
    return F.coalesce(F.floor(a / step + num(1e-9)) * step, num(0)), F.coalesce(F.ceil(b / step - num(1e-9)) * step, num(1))
