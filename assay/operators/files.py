"""What is asked of files' parts and of a run queue: entry sections, libraries, entropies of counts, lists of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_ahead(jobs: DataFrame, queue: list[str], order: list[str], waiting: Column, into: str = "ahead") -> DataFrame:
    """jobs with the number of those that wait before each in its queue."""
    before = Window.partitionBy(*queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return jobs.withColumn(into, F.count_if(waiting).over(before))


def argmax_section(sections: DataFrame, file: str, weight: str, position: str, into: str = "entry") -> DataFrame:
    """(file, position of its heaviest section); of equals the first."""
    return sections.groupBy(file).agg(F.max_by(position, F.struct(weight, (-F.col(position)).alias("_first"))).alias(into))


def library_rollup(imports: DataFrame, library: str, used: Column) -> DataFrame:
    """(library, present, n): whether and how often a library's functions are used."""
    return imports.groupBy(library).agg(F.coalesce(F.bool_or(used), F.lit(False)).alias("present"), F.count_if(used).alias("n"))


def first_per_library(imports: DataFrame, library: str, position: str, used: Column, into: str) -> DataFrame:
    """(library, position of its first function that is used)."""
    return imports.where(used).groupBy(library).agg(F.min(position).alias(into))


def entropy_bits(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """(keys, bits): the entropy of each group's counts; groups without any have 0. One aggregation: H = log2 n - sum c log2 c / n."""
    c = F.col(count).cast("double")
    n = F.sum(c)
    own = F.sum(F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0)))
    return counts.groupBy(*keys).agg(F.when(n > 0, F.greatest(F.log2(n) - own / n, F.lit(0.0))).otherwise(F.lit(0.0)).alias("bits"))


def split_ids(text: Column) -> Column:
    """The distinct ids of a list with commas, in order, without blanks around them and without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))
