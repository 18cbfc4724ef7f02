"""The drift windows as a stream: per-window confusion counts with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scored_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows (ts timestamp, label, score) from Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def window_counts(rows: DataFrame, threshold: float, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """tp, fp, fn, tn of each tumbling window; partial sums are the state, so it is one row a window."""
    hit, mal = F.col("score") >= threshold, F.col("label") == 1
    out = rows.where("label >= 0").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return out.agg(F.count_if(hit & mal).alias("tp"), F.count_if(hit & ~mal).alias("fp"), F.count_if(~hit & mal).alias("fn"), F.count_if(~hit & ~mal).alias("tn")).select("w.start", "w.end", "tp", "fp", "fn", "tn")


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
