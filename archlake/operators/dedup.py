"""Content duplicates inside archives as references to their first physical copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_offsets(members: DataFrame) -> DataFrame:
    """Members in physical order with where the next one starts; the last one's next is cd_offset where given."""
    w = Window.partitionBy("archive").orderBy("off")
    last = F.col("cd_offset") if "cd_offset" in members.columns else F.col("off") + F.col("csize") + 60
    return members.withColumn("next_off", F.coalesce(F.lead("off").over(w), last))


def plan(members: DataFrame, overhead: int = 44, first_overhead: int = 24) -> DataFrame:
    """archive, idx, source_idx of the members that become references.

    Of equal contents the first by offset is the source; a later one is
    replaced if that saves bytes, the first replaced one paying for the
    source's identifier. Order decides: a small copy can fail and a later,
    larger one succeed. Empty members and references never take part.
    """
    rows = next_offsets(members).where("usize > 0 and method <> 92").withColumn("gain", F.col("next_off") - F.col("off") - F.col("loclen"))
    key = Window.partitionBy("archive", "usize", "sha1")
    rows = rows.withColumn("rn", F.row_number().over(key.orderBy("off"))).withColumn("source_idx", F.first("idx").over(key.orderBy("off")))
    first = F.min(F.when((F.col("rn") > 1) & (F.col("gain") > overhead + first_overhead), F.col("off"))).over(key)
    rows = rows.withColumn("first_ok", first)
    return rows.where((F.col("rn") > 1) & (F.col("off") >= F.col("first_ok")) & (F.col("gain") > overhead)).select("archive", "idx", "source_idx", (F.col("gain") - overhead).alias("saved"))


def savings(members: DataFrame, first_overhead: int = 24) -> DataFrame:
    """References, sources and net bytes saved of each archive."""
    p = plan(members, first_overhead=first_overhead)
    return p.groupBy("archive").agg(F.count("*").alias("refs"), F.countDistinct("source_idx").alias("sources"), (F.sum("saved") - first_overhead * F.countDistinct("source_idx")).alias("net_saved"))


def resolve(refs: DataFrame, members: DataFrame) -> DataFrame:
    """Each reference's source by digest in its archive: same identifier first, then the first physical one."""
    c = members.select("archive", F.col("sha1"), F.col("idx").alias("source_idx"), F.col("off").alias("source_off"), F.col("uuid").alias("source_uuid"))
    best = F.min_by("source_idx", F.struct(F.when(F.col("uuid") == F.col("source_uuid"), 0).otherwise(1), "source_off"))
    return refs.join(c, ["archive", "sha1"], "left").where("source_idx is null or source_idx <> idx").groupBy("archive", "idx").agg(best.alias("source_idx"))


def broken_by(refs: DataFrame, changed: DataFrame) -> DataFrame:
    """References whose source is among the members that would change (archive, idx)."""
    return refs.join(changed.select("archive", F.col("idx").alias("source_idx")), ["archive", "source_idx"], "left_semi")
