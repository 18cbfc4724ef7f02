"""What the operators share: intermediate tables, row keys and hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.sources.staging import shared_path as shared_path
from assay.sources.staging import staged as staged


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets: one for each shuffle partition of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod), F.lit(-1)).cast("int")


def free(name: str, taken: list[str]) -> str:
    """name, or with signs behind it, as none of the taken names is (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def named(out: DataFrame, own: str, id_col: str) -> DataFrame:
    """A result whose ids take the name that they had; another of its columns with that name gets a sign behind its own."""
    return out.select(*[F.col(f"`{c}`").alias(id_col if c == own else free(c, [id_col])) for c in out.columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... (lengths[i] of them) for all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
