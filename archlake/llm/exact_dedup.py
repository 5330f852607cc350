"""Exact duplicates by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so; its recipe
is the ordered list of chunk fingerprints. Only texts whose recipe occurs
again go on: their distinct chunks are brought together once, by fingerprint
and bytes, which gives each chunk a verified identifier (fingerprint and the
rank of its bytes among chunks of that fingerprint), and texts are equal when
their ordered identifier lists are. Long texts are never compared or moved
as a whole.

Nulls count as empty texts, empty texts are equal. Rows that are repeated
count as members; of rows with the largest doc_id each is kept. A row
without doc_id is kept only if its group has no doc_id at all. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitmaps, ragged, tables

_GEAR = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)


def _cuts(text: bytes, bits: int, step: int = 1 << 18) -> Iterator[int]:
    """Places after bytes where the hash of the last 32 has `bits` low zeros, `step` bytes hashed at a time."""
    for lo in range(0, len(text), step):
        start = max(0, lo - 31)
        h = _GEAR[np.frombuffer(text, np.uint8)[start : lo + step]]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
        yield from (np.flatnonzero((h[lo - start :] >> np.uint64(20)) & np.uint64((1 << bits) - 1) == 0) + lo + 1).tolist()


def boundaries(text: bytes, bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks: where the hash of 32 bytes has `bits` low zeros, `least` to `most` bytes apart."""
    n, out, last = len(text), [], 0
    if n > least:
        for c in _cuts(text, bits):
            if c - last < least:
                continue
            while c - last > most:
                last += most
                out.append(last)
            if c - last >= least:
                out.append(last := c)
        while n - last > most:
            last += most
            out.append(last)
    if last < n or not out:
        out.append(n)
    return out


def _recipes(batches: Iterator[pa.RecordBatch], bitmap=None) -> Iterator[pa.RecordBatch]:
    """Rows key, doc_id, sha, recipe; with a bitmap, of rows whose h it lets through: key, at, fp, chunk."""
    chunks = bitmap is not None
    words = bitmaps.opened(bitmap) if chunks else None
    for batch in batches:
        if chunks:
            batch = batch.filter(pa.array(bitmaps.maybe(words, batch.column("h").to_numpy(zero_copy_only=False))))
        for lo, hi in ragged.slices(batch.column("text"), 2 << 20):
            part = batch.slice(lo, hi - lo)
            data, off = ragged.utf8(part.column("text"))
            text = ragged.LOWER[data].tobytes()
            shas, recipes, pieces, at = [], [], [], []
            for i in range(len(part)):
                t = text[off[i] : off[i + 1]]
                ends = boundaries(t)
                own = [t[a:b] for a, b in zip([0, *ends], ends)]
                shas.append(hashlib.sha256(t).hexdigest())
                recipes.append([xxhash.xxh64_intdigest(c) - 2**63 for c in own])
                if chunks:
                    pieces += own
                    at += range(len(own))
            if chunks:
                n = [len(r) for r in recipes]
                again = np.repeat(np.arange(len(part)), n)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(again)), pa.array(np.array(at, np.int32)), pa.array([f for r in recipes for f in r], pa.int64()), pa.array(pieces, pa.binary())], ["key", "at", "fp", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(shas), pa.array(recipes, pa.list_(pa.int64()))], ["key", "doc_id", "sha", "recipe"])


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key, doc_id, keep_id, keep_key (one row's key in each group, of those with keep_id), group_size, sha."""
    docs = docs.select(tables.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    recipes = tables.cut(
        docs.mapInArrow(_recipes, "key binary, doc_id long, sha string, recipe array<long>")
        .select("key", "doc_id", "sha", "recipe", F.xxhash64("recipe").alias("rh"))
    )
    # Both tables are cut so that the joins read plain exchanges, whose hot partitions Spark can split.
    again = tables.cut(recipes.groupBy("rh").agg(F.count("*").alias("n")).where("n > 1").select("rh"))
    several = recipes.join(again, "rh", "left_semi")
    # Only texts that a bitmap of those rows' keys lets through are cut into chunks; what it lets through besides does no harm.
    bitmap = bitmaps.build(several.select(F.xxhash64("key").alias("h")))
    chunks = docs.select("key", F.xxhash64("key").alias("h"), "text").mapInArrow(lambda it: _recipes(it, bitmap), "key binary, at int, fp long, chunk binary")
    # Fingerprints that stand for several byte strings: none in practice.
    clash = tables.cut(chunks.groupBy("fp", "chunk").count().groupBy("fp").count().where("count > 1").select("fp"))
    if clash.take(1):
        held = tables.cut(chunks.join(clash, "fp", "left_semi"))
        rank = held.select("fp", "chunk").distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy("fp").orderBy("chunk")))
        ranked = held.join(rank, ["fp", "chunk"]).groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("at", "rank"))).alias("ranks"))
        several = several.join(ranked, "key", "left")
    else:
        several = several.withColumn("ranks", F.lit(None).cast("map<int,int>"))
    rank_of = lambda i: F.coalesce(F.col("ranks")[i.cast("int")], F.lit(0)).cast("string")
    lists = several.select("key", "doc_id", "sha", F.concat_ws(",", F.transform("recipe", lambda f, i: F.concat_ws(":", f.cast("string"), rank_of(i)))).alias("list"))
    groups = lists.groupBy("list").agg(F.max(F.struct("doc_id", "key")).alias("top"), F.count("*").alias("group_size"))  # a null is less than any doc_id
    groups = tables.cut(groups.select("list", F.col("top.doc_id").alias("keep_id"), F.col("top.key").alias("keep_key"), "group_size"))
    members = lists.join(groups, "list").select("key", "doc_id", "keep_id", "keep_key", "group_size", "sha")
    alone = recipes.join(again, "rh", "left_anti").select("key", "doc_id", F.col("doc_id").alias("keep_id"), F.col("key").alias("keep_key"), F.lit(1).cast("long").alias("group_size"), "sha")
    return members.unionByName(alone)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs, id_col, text_col).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(tables.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of equal texts one row stays, one with the largest doc_id; one without doc_id only if none has any."""
    return tables.kept(docs, _grouped(docs))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
