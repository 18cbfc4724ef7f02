"""Ranks within groups, of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.selection import sample_key


def hash_ranked(rows: DataFrame, keys: list[str], seed: int, name: str = "rank", key: str = "row_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their rank from 1 within keys, in order of the hash of seed and key (ties by key, then by the columns `ties`).

    The hash's first byte cuts every group into 256 cells of equal share; a row's rank is the rows of the cells
    before plus its place in its own. The hash goes to its cell as bytes, half of its digits and in the same order.
    """
    df = rows.withColumn("_h", F.unhex(sample_key(seed, key))).withColumn("_cell", F.substring("_h", 1, 1))
    cells = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_h", key, *ties))
    return df.withColumn("_own", own).join(cells, [*keys, "_cell"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).select(*rows.columns, name)
