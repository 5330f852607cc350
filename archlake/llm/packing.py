"""Conflict-constrained best-fit packing of documents into fixed windows.

Texts become pieces: as many full windows as they fill, which are bins of
their own, and the rest. Rests are dealt evenly to shards by a hash of
document and piece, whatever their source or cluster, and each shard packs
its own, longest first. Its bins lie in one array ordered by residual; each
has a bitmap of the sources and one of the duplicate clusters it holds. The
successor search starts at the least residual that takes the piece and goes
on until a bin without either bit is found: the tightest compatible one.

No bin holds two rests of one source or one duplicate cluster. Nulls and
empty texts take no room and get no bin (bin_id null, length 0). Rows without
source or cluster conflict with nothing through it. Repeated rows are packed
like any other, ties go by document and piece. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


def best_fit(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, step: int = 256) -> np.ndarray:
    """Bin of each piece, in the order given. source, cluster: small numbers, or -1."""
    n = len(length)
    residual = np.empty(n, np.int64)  # ascending; the first `m` count
    place = np.empty(n, np.int64)  # the bin's number
    bits = [np.zeros((n, int(x.max(initial=-1)) // 64 + 1), np.uint64) for x in (source, cluster)]
    out, m, bins = np.empty(n, np.int64), 0, 0
    for i in range(n):
        marks = [(b[:, x >> 6], np.uint64(1) << np.uint64(x & 63)) for b, x in ((bits[0], int(source[i])), (bits[1], int(cluster[i]))) if x >= 0]
        at, lo = -1, int(np.searchsorted(residual[:m], length[i]))
        while lo < m:
            own = place[lo : min(m, lo + step)]
            free = np.ones(len(own), bool)
            for word, bit in marks:
                free &= word[own] & bit == 0
            j = int(free.argmax())
            if free[j]:
                at = lo + j
                break
            lo += step
        if at < 0:
            b, left = bins, capacity - length[i]
            bins += 1
        else:
            b, left = int(place[at]), residual[at] - length[i]
            residual[at : m - 1], place[at : m - 1] = residual[at + 1 : m].copy(), place[at + 1 : m].copy()
            m -= 1
        to = int(np.searchsorted(residual[:m], left))
        residual[to + 1 : m + 1], place[to + 1 : m + 1] = residual[to:m].copy(), place[to:m].copy()
        residual[to], place[to] = left, b
        m += 1
        for word, bit in marks:
            word[b] |= bit
        out[i] = b
    return out


def _shard(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last")
        marks = []
        for c in ("source", "cluster"):
            code, _ = pd.factorize(pdf[c])  # -1: null
            count = np.bincount(code[code >= 0], minlength=1)
            alone = (code >= 0) & (count[code] < 2)  # a mark that no other piece of the shard has needs no bit
            kept = np.where(alone, -1, code)
            _, small = np.unique(kept[kept >= 0], return_inverse=True)
            kept[kept >= 0] = small
            marks.append(kept.astype(np.int64))
        pdf["bin"] = best_fit(pdf["length"].to_numpy(np.int64), *marks, capacity)
        return pdf[["doc_id", "piece", "start", "length", "shard", "bin"]]

    return pack


def pack(docs: DataFrame, length: Column, cluster: Column, capacity: int, per_shard: int = 8192, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, piece, start, length, bin_id of every piece; start and length in the unit of `length`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"))
    rows = tables.cut(rows)  # texts are read once
    shards = max(1, -(-rows.count() // per_shard))
    whole = rows.where(F.col("n") >= capacity).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {capacity} - 1"))).alias("piece")
    ).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
        F.concat_ws("-", F.lit("w"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string")).alias("bin_id"),
    )
    rest = rows.where(F.col("n") % capacity > 0).select(
        "doc_id", "source", "cluster", F.expr(f"n div {capacity}").alias("piece"), F.expr(f"n - n % {capacity}").alias("start"), (F.col("n") % capacity).alias("length")
    )
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "source", "length"), F.lit(shards)).cast("int"))
    packed = rest.groupBy("shard").applyInPandas(_shard(capacity), "doc_id long, piece long, start long, length long, shard int, bin long").select(
        "doc_id", "piece", "start", "length", F.concat_ws("-", F.lit("b"), F.col("shard").cast("string"), F.col("bin").cast("string")).alias("bin_id")
    )
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("bin_id"))
    return packed.unionByName(whole).unionByName(none)


#: Windows of about 2,048 tokens at 4 bytes a token.
CAPACITY = 8192


def by_bytes(docs: DataFrame) -> DataFrame:
    """Lengths are UTF-8 bytes; a cluster is the documents of one text."""
    return pack(docs, F.octet_length("text"), F.md5("text"), CAPACITY)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_bytes(tables.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the windows' content, a row a piece."""
    return by_bytes(docs)
