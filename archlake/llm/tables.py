"""Tables cut from their lineage, kept in the shared folder of spark.checkpoint.dir, and rows told apart."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local session, as in tests, gets a folder of its own; a cluster's raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = f"file://{tempfile.mkdtemp(prefix='archlake-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Rows that a Python worker gets at a time, at most: batches of whole texts are held on both sides of the pipe.
BATCH = 2000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, its Arrow batches of at most BATCH rows from now on; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH:
        spark.conf.set(_BATCH_KEY, str(BATCH))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet and reads it: survives lost executors, and Spark knows its size when it joins."""
    spark = bounded(df.sparkSession)
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*dfs: DataFrame | None) -> None:
    """Deletes what cut() wrote, once nothing reads it."""
    for df in dfs:
        path = getattr(df, "_kept_at", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text; a null is neither an empty text nor any id."""
    id_, text = F.col(id_col).cast("string"), F.col(text_col)
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.octet_length(id_).cast("string"), F.lit(":"), id_), F.lit("-")), F.coalesce(F.concat(F.lit("+"), text), F.lit("-")))))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of the keys that `gone` has; gone: key, one (whether one row of it stays), a row a key.

    Only rows that a bitmap lets through move to a join, the others stay where
    they are. docs' columns are held as one, so their names can't clash.
    """
    gone = cut(gone)
    bitmap = bitmaps.build(gone.select(F.xxhash64("key").alias("h")))
    rows = docs.select(F.xxhash64(row_key(id_col, text_col)).alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rest = bitmaps.sieve(rows, "h", bitmap, inside=False).select("doc.*")
    some = bitmaps.sieve(rows, "h", bitmap).select("doc").withColumn("key", row_key(f"doc.{id_col}", f"doc.{text_col}"))
    joined = some.join(gone, "key", "left_anti").select("doc.*")
    again = gone.where("one").select("key")
    once = some.join(again, "key", "left_semi").dropDuplicates(["key"]).select("doc.*") if again.take(1) else None
    out = rest.unionByName(joined)
    return out if once is None else out.unionByName(once)


def kept(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs' rows whose key is their group's keep_key; of identical rows one. grouped: key and keep_key, a row for each of docs."""
    counted = grouped.groupBy("key").agg(F.count("*").alias("n"), F.any_value(F.col("key") == F.col("keep_key")).alias("stays"))
    return without(docs, counted.where("not stays or n > 1").select("key", F.col("stays").alias("one")))
