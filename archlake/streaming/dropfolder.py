"""Archives that arrive in a folder, as a stream of their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.sources import ziparchive


def arriving(spark: SparkSession, path: str, table: str = "members", mode: str = "LENIENT", per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", per_batch).load(path)
    return ziparchive.tables_of(files, table, mode)


def late_pairs(owners: DataFrame, companions: DataFrame, within: str = "1 hour") -> DataFrame:
    """Owners with companions that come before or after them; owners alone once the watermark has passed. Both: id, ts."""
    o = owners.withWatermark("ts", within).alias("o")
    c = companions.withWatermark("ts", within).alias("c")
    near = F.expr(f"o.id = c.id and c.ts between o.ts - interval {within} and o.ts + interval {within}")
    return o.join(c, near, "left_outer").select("o.id", "o.ts", F.col("c.ts").alias("companion_ts"))
