"""JSON values: canonical forms, flattening, merging, cleaning. Trees of any depth need a walk, so these run on Arrow batches."""

from __future__ import annotations

import json
import math
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no blanks; null stays null."""
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def flat(value, prefix: str = "") -> dict:
    """Nested objects as dotted keys; empty objects and lists are values."""
    out = {}
    for k, v in value.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        out |= flat(v, key) if isinstance(v, dict) and v else {key: v}
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flatten(values: pd.Series) -> pd.Series:
    """A JSON object as a map of dotted keys to canonical JSON."""
    one = lambda v: {k: json.dumps(x, sort_keys=True, separators=(",", ":")) for k, x in flat(json.loads(v)).items()}
    return values.map(lambda v: None if v is None else one(v))


def merge(base, over):
    """Objects merged key by key, the right one wins."""
    if not isinstance(base, dict) or not isinstance(over, dict):
        return over
    return {**base, **{k: merge(base[k], v) if k in base else v for k, v in over.items()}}


@F.pandas_udf(T.StringType())
def deep_merge(base: pd.Series, over: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(merge(json.loads(a), json.loads(b)), sort_keys=True, separators=(",", ":")) for a, b in zip(base, over, strict=True)])


def to_jsonable(value):
    """Plain JSON types: numbers that aren't finite become null, dates ISO text, enumerations their value, sets and tuples lists."""
    if isinstance(value, dict):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [to_jsonable(v) for v in (sorted(value, key=str) if isinstance(value, set | frozenset) else value)]
    if hasattr(value, "tolist"):  # numpy
        return to_jsonable(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, bool | int | str):
        return value
    if hasattr(value, "value"):
        return to_jsonable(value.value)
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def jsonable(struct: Column, fields: list[T.StructField]) -> Column:
    """to_json of a struct in which doubles that aren't finite are null."""
    own = lambda f: F.when(~F.isnan(struct[f.name]) & (F.abs(struct[f.name]) < math.inf), struct[f.name]) if isinstance(f.dataType, T.DoubleType | T.FloatType) else struct[f.name]
    return F.to_json(F.struct(*[own(f).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def scrubbed(text: Column, private_dirs: list[str], mark: str = "[private]") -> Column:
    """Text without mentions of private folders and of the paths below them."""
    forms = sorted({x for d in private_dirs for x in (d, os.path.abspath(d)) if x and x != os.sep}, key=len, reverse=True)
    if not forms:
        return text
    return F.regexp_replace(text, "(?:" + "|".join(map(re.escape, forms)) + r""")(?:[/\\][^\s"'<>|:*?]*)?""", mark)


def config_diff(reports: DataFrame, run_col: str, json_col: str) -> DataFrame:
    """(key, values): dotted keys whose values differ between runs (one row a run), values by run; a key that a run lacks counts as a value."""
    flat_ = reports.select(F.col(run_col).alias("run"), F.explode(flatten(json_col)).alias("key", "value"))
    n = reports.agg(F.count(F.lit(1)).alias("n"))
    by = flat_.groupBy("key").agg(F.count(F.lit(1)).alias("have"), F.countDistinct("value").alias("kinds"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "value")))).alias("values"))
    return by.crossJoin(F.broadcast(n)).where("kinds > 1 or have < n").select("key", "values")  # one row


def policy_keys(diff: DataFrame) -> DataFrame:
    """Keys that change how a run is scored."""
    return diff.where(F.col("key").rlike(r"^(modules\.|verdict\.|fail_on)"))
