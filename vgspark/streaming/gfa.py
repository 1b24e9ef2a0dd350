"""Bubble graphs whose GFA files arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def segment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``(graph_id, name, seq)`` of the S lines of GFA files as they arrive in ``folder``."""
    raw = spark.readStream.text(folder).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.gfa)?(\.gz)?$", 1).alias("graph_id"))
    f = F.filter(F.split("value", "\t"), lambda x: x != "")
    rows = raw.where(F.substring("value", 1, 1) == "S").select("graph_id", f.alias("f")).where(F.size("f") >= 3)
    return rows.select("graph_id", F.get("f", F.lit(1)).alias("name"), F.when(F.get("f", F.lit(2)) == "*", "").otherwise(F.get("f", F.lit(2))).alias("seq"))


def segment_totals(segments: DataFrame) -> DataFrame:
    """``(graph_id, n_segments, n_bases)``, kept up to date."""
    return segments.groupBy("graph_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("seq")).alias("n_bases"))
