"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS_LINE = 0.75


def dbl(x) -> Column:
    return F.lit(float(x))


def num(x) -> Column:
    """A column as it is, a number as a double literal."""
    return x if isinstance(x, Column) else F.lit(float(x))


def metric_score(value: Column, op: str, threshold, ideal, floor, log: bool = False) -> Column:
    """0 at floor, PASS_LINE at threshold, 1 at ideal, linear (or in log10) between; a value that fails a strict
    comparison stays below PASS_LINE; null for null and NaN."""
    sign = 1.0 if op.startswith(">") else -1.0
    axis = (lambda c: F.log10(F.greatest(c, dbl(1e-12)))) if log else (lambda c: c)
    v, t, i, f = (axis(c) * dbl(sign) for c in (value.cast("double"), num(threshold), num(ideal), num(floor)))
    line = dbl(PASS_LINE)
    s = F.when(v >= i, dbl(1)).when(v >= t, line + (dbl(1) - line) * (v - t) / (i - t)).when(v <= f, dbl(0)).otherwise(line * (v - f) / (t - f))
    passes = v >= t if op.endswith("=") else v > t
    s = F.when(passes, F.greatest(s, line)).otherwise(F.least(s, line - dbl(1e-6)))
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), s)


def ramp_log(value: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi, linear in the logarithm between."""
    at = (F.log(F.greatest(value, dbl(lo))) - F.log(dbl(lo))) / (F.log(dbl(hi)) - F.log(dbl(lo)))
    return F.least(F.greatest(at, dbl(0)), dbl(1))


def log_confidence(score: Column, label: Column) -> Column:
    """log P(true label), with floors that keep it finite."""
    malicious = F.log(F.greatest(score, dbl(1e-300)))
    benign = F.log1p(-F.least(score, dbl(1 - 2.0**-53)))
    return F.when(label == 1, malicious).otherwise(benign)


def logistic(raw: Column, scale: float = 1.0) -> Column:
    return dbl(1) / (dbl(1) + F.exp(-dbl(scale) * raw))


def module_seed(seed: Column, module: Column) -> Column:
    return F.pmod(seed * F.lit(1000003) + F.crc32(module.cast("binary")), F.lit(4294967296))


def month_start(text: Column) -> Column:
    """First day of a leading YYYY-MM; null if there is none."""
    part = F.regexp_extract(text, r"^(\d{4}-\d{2})", 1)
    return F.when(part != "", F.try_to_timestamp(F.concat(part, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))


def parse_cutoff(text: Column) -> Column:
    """YYYY, YYYY-MM, YYYY-MM-DD or a date-time to a day; a year or month means its last day."""
    t = F.trim(text)
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(t.rlike(r"^\d{4}$"), day(F.concat(t, F.lit("-12-31"))))
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.last_day(day(F.concat(t, F.lit("-01")))))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), day(F.substring(t, 1, 10)))
    )


def norm_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")


def alias_hex(name: Column) -> Column:
    return F.concat(F.lit("enc-"), F.lower(F.hex(F.encode(name, "UTF-8"))))


def alias_unhex(alias: Column) -> Column:
    return F.when(alias.rlike("^enc-([0-9a-f]{2})+$"), F.decode(F.unhex(F.substring(alias, 5, 1 << 20)), "UTF-8"))


def secret_like(key: Column) -> Column:
    return F.lower(key).rlike("token|secret|password|passwd|cookie|key$")


def public_items(items: Column) -> Column:
    """A map's entries in order of their keys, without those that look like secrets."""
    return F.array_sort(F.map_entries(F.map_filter(items, lambda k, v: ~secret_like(k))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def safe_file_name(text: Column) -> Column:
    """The last path part, runs of other characters than [A-Za-z0-9._-] as one '_'; at most 128, of which a short
    extension survives the cut. Null for names that are empty, begin with a dot or hold nothing but dots and '_'."""
    base = F.trim(F.regexp_extract(text, r"([^/\\]*)$", 1))
    name = F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_")
    tail = F.regexp_extract(name, r"(\.[^.]{1,15})$", 1)
    cut = F.when((tail != "") & (F.length(tail) < F.length(name)), F.concat(F.substr(name, F.lit(1), F.lit(128) - F.length(tail)), tail)).otherwise(F.substring(name, 1, 128))
    ok = ~base.startswith(".") & ~name.rlike(r"^[._]*$")
    return F.when(ok, F.when(F.length(name) > 128, cut).otherwise(name))


def sniff_format(head: Column) -> Column:
    """Format by the first bytes of a file."""
    h = F.hex(F.substring(head, 1, 8))
    return (
        F.when(h.startswith("504B0304"), "zip").when(h.startswith("1F8B"), "gzip").when(h.startswith("FD377A585A"), "xz").when(h.startswith("425A68"), "bzip2")
        .when(h.startswith("894844460D0A1A0A"), "hdf5").when(h.startswith("934E554D5059"), "npy").when(h.rlike("^80(02|03|04|05)"), "pickle")
        .when(h.startswith("7472656"), "lightgbm_text").when(h.startswith("7B"), "json").otherwise("unknown")
    )
