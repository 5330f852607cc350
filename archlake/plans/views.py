"""Member-shaped views of the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members: an archive for each language."""
    d = table(spark, sf_dir, "documents")
    m = d.select(
        F.col("lang").alias("archive"), F.col("doc_id").alias("idx"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length("text").cast("long").alias("usize"), F.expr("element_at(array(0, 8, 12, 14, 93), cast(doc_id % 5 as int) + 1)").alias("method"),
        F.expr("timestampadd(HOUR, cast(doc_id as int), timestamp'2024-01-01 00:00:00')").alias("mtime"), F.sha1("text").alias("sha1"), "text",
    )
    m = m.withColumn("csize", F.expr("usize - (usize * (idx % 10)) div 20"))
    w = Window.partitionBy("archive").orderBy("idx")
    return m.withColumn("off", (F.sum(F.col("csize") + 60).over(w) - (F.col("csize") + 60)).cast("long")).withColumn("loclen", F.lit(35).cast("long"))


def on_disk(members: DataFrame) -> DataFrame:
    """Two thirds of the members, some newer (by a second too, or two), older or larger, and some new ones."""
    hour = lambda shift: F.expr(f"timestampadd(SECOND, cast(idx % 5 - 1 as int), timestampadd(HOUR, cast({shift} as int), mtime))")
    old = members.where("idx % 3 <> 0").select("archive", "name", hour("idx % 4 - 1").alias("mtime"), (F.col("usize") + F.when(F.col("idx") % 11 == 0, 1).otherwise(0)).alias("usize"))
    return old.unionByName(members.where("idx % 7 = 0").select("archive", F.concat(F.lit("new/"), "name").alias("name"), "mtime", "usize"))


MEMBERS_SQL = """
m0 AS (SELECT lang AS archive, doc_id AS idx, source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS name, octet_length(encode(text))::BIGINT AS usize,
              [0, 8, 12, 14, 93][doc_id % 5 + 1] AS method, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INT) AS mtime, sha1(text) AS sha1, text FROM documents),
m1 AS (SELECT *, usize - (usize * (idx % 10)) // 20 AS csize FROM m0),
members AS (SELECT *, (sum(csize + 60) OVER (PARTITION BY archive ORDER BY idx) - (csize + 60))::BIGINT AS off, 35::BIGINT AS loclen FROM m1)
"""
FS_SQL = """
fs AS (SELECT archive, name, mtime + to_hours((idx % 4 - 1)::INT) + to_seconds((idx % 5 - 1)::INT) AS mtime, usize + CASE WHEN idx % 11 = 0 THEN 1 ELSE 0 END AS usize FROM members WHERE idx % 3 <> 0
       UNION ALL SELECT archive, 'new/' || name, mtime, usize FROM members WHERE idx % 7 = 0)
"""
PERMILLE_SQL = "CASE WHEN {u} = 0 THEN 0 ELSE sign({u} - {c})::BIGINT * CASE WHEN {u} > 2000000 THEN (abs({u} - {c}) + ({u} // 1000) // 2) // greatest({u} // 1000, 1) ELSE (1000 * abs({u} - {c}) + {u} // 2) // greatest({u}, 1) END END"
