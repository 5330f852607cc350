"""Connected components by alternating large and small stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller neighbours to its least one. edges: a > b, distinct."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = tables.cut(both)  # a plain table on either side: hot nodes' partitions can be split in the join
    least = tables.cut(both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m")))
    joined = both.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = tables.cut(out.where("a > b").distinct())
    tables.drop(both)
    tables.drop(least)
    return out


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of one type, in any order and direction. Returns node, component (its least node) of all but the least nodes."""
    x, y = edges.columns
    edges = tables.cut(edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    before = _digest(edges)
    while before[0]:
        step = _star(edges, True)
        tables.drop(edges)
        edges = _star(step, False)
        tables.drop(step)
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
