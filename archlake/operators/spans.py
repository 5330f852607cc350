"""Byte spans of members: overlaps, gaps and cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _before():
    return Window.partitionBy("archive").orderBy("beg", "end").rowsBetween(Window.unboundedPreceding, -1)


def overlaps(spans: DataFrame) -> DataFrame:
    """Spans (archive, idx, beg, end) that start before an earlier one has ended."""
    return spans.withColumn("reached", F.max("end").over(_before())).where("beg < reached").select("archive", "idx", "beg", "reached")


def gaps(spans: DataFrame) -> DataFrame:
    """Bytes between spans that none covers."""
    return spans.withColumn("reached", F.max("end").over(_before())).where("beg > reached").select("archive", "idx", F.col("reached").alias("gap_beg"), (F.col("beg") - F.col("reached")).alias("gap_bytes"))


def merged(spans: DataFrame) -> DataFrame:
    """Disjoint spans that cover the same bytes; adjacent ones become one."""
    s = spans.withColumn("fresh", F.when(F.col("beg") <= F.max("end").over(_before()), 0).otherwise(1))
    s = s.withColumn("island", F.sum("fresh").over(Window.partitionBy("archive").orderBy("beg", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("archive", "island").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("island")


def within(points: DataFrame, cover: DataFrame) -> DataFrame:
    """Points (archive, at) inside a merged cover: each is held against the one span that starts last before it."""
    both = cover.select("archive", F.col("beg").alias("x"), F.lit(0).alias("kind"), F.col("end").alias("until"), F.lit(None).cast("long").alias("at"))
    both = both.unionByName(points.select("archive", F.col("at").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("until"), F.col("at")))
    w = Window.partitionBy("archive").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reach", F.last("until", True).over(w)).where("kind = 1 and at < reach").select("archive", "at")
