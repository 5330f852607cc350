"""Benchmark decontamination by winnowing.

Of every window of `w` consecutive k-grams the least hash is a fingerprint, so
any span of k + w - 1 words that a document shares with an item puts one
fingerprint in both. Items shorter than that are one window: their
fingerprint is the hash of all their words. A bitmap of fixed size of the
items' fingerprints goes to all machines and lets documents pass on only
fingerprints that may match; those are joined with the items', and each
(document, item) hit is extended on the words themselves.

Null and empty texts have no words, items without words no windows. Items of
one text count each. Items without item_id count like others in n_hit, and all
of them as one in n_items; they are left out of items_sha256 only. Repeated
rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, ragged, tables


def _tokens(column: pa.Array) -> tuple:
    data, off = ragged.utf8(column)
    data = ragged.LOWER[data]
    ws, we, ptr = ragged.words(data, off, ragged.NON_WORD)
    return data, ws, we, ptr, ragged.word_hashes(data, ws, we)


def _item_marks(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = k + w - 1
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                *_, ptr, h = _tokens(part.column("text"))
                at, fp = ragged.winnow(h, ptr, k, w)
                own, n = ragged.owners(ptr)[at], np.diff(ptr)
                short = np.zeros(len(at), np.int32)
                for m in range(1, size):
                    few = np.flatnonzero(n == m)
                    if len(few):
                        own, fp = np.concatenate([own, few]), np.concatenate([fp, ragged.grams(h, m)[ptr[few]]])
                        short = np.concatenate([short, np.full(len(few), m, np.int32)])
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(own)), pa.array(ragged.signed(fp)), pa.array(short)], ["item", "fp", "short"])

    return run


def _doc_marks(k: int, w: int, bitmap, shorts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmaps.opened(bitmap)
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                *_, ptr, h = _tokens(part.column("text"))
                own, n = ragged.owners(ptr), np.diff(ptr)
                at, fp = ragged.winnow(h, ptr, k, w)
                owns, fps = [], []
                for at, fp in [(at, fp), *((np.flatnonzero(x := ragged.inside(ptr, m)), ragged.grams(h, m)[x]) for m in shorts)]:
                    hit = bitmaps.maybe(bits, fp)
                    owns.append(own[at[hit]])
                    fps.append(fp[hit])
                own, fp = np.concatenate(owns), np.concatenate(fps)
                order = np.lexsort((fp, own))
                own, fp = own[order], fp[order]
                if len(fp):
                    fresh = np.append(True, (own[1:] != own[:-1]) | (fp[1:] != fp[:-1]))
                    own, fp = own[fresh], fp[fresh]
                ends = np.searchsorted(own, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ragged.signed(fp)))
                text = part.column("text").to_pylist()
                kept = pa.array([t if c else None for t, c in zip(text, np.diff(ends))], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(n.astype(np.int64)), lists, kept], ["key", "doc_id", "n_words", "fps", "text"])

    return run


def _extend(size: int):
    """Words of a document inside occurrences of an item's windows; compared as words."""

    def spelled(text: str | None) -> list[bytes]:
        data, ws, we, _, _ = _tokens(pa.array([text], pa.string()))
        data = data.tobytes()
        return [data[a:b] for a, b in zip(ws.tolist(), we.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items, hits, last = [], [], [], (None, None)
            for key, item, text, item_text in zip(*(batch.column(c).to_pylist() for c in ("key", "item_id", "text", "item_text"))):
                doc = last[1] if last[0] == text else spelled(text)
                last, own = (text, doc), spelled(item_text)
                k = min(size, len(own))
                starts: dict[bytes, set] = {}
                for j in range(len(own) - k + 1):
                    starts.setdefault(own[j], set()).add(tuple(own[j : j + k]))
                inside = set()
                for i, word in enumerate(doc[: len(doc) - k + 1]):
                    if word in starts and tuple(doc[i : i + k]) in starts[word]:
                        inside.update(range(i, i + k))
                if inside:
                    keys.append(key)
                    items.append(item)
                    hits.append(sorted(inside))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.string()), pa.array(hits, pa.list_(pa.int32()))], ["key", "item_id", "hits"])

    return run


def _contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    w = window - k + 1
    items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.withColumn("item", tables.row_key("item_id", "text"))
    marks = tables.cut(items.mapInArrow(_item_marks(k, w), "item binary, fp long, short int").distinct())
    shorts = sorted(r[0] for r in marks.where("short > 0").select("short").distinct().collect())
    docs = docs.select(tables.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = bitmaps.build(marks.select("fp"))
    rows = tables.cut(docs.mapInArrow(_doc_marks(k, w, shared, shorts), "key binary, doc_id long, n_words long, fps array<long>, text string"))
    some = rows.where("size(fps) > 0")
    pairs = some.select("key", F.explode("fps").alias("fp")).join(marks.select("fp", "item"), "fp").select("key", "item").distinct()
    texts = items.withColumnRenamed("text", "item_text")
    hits = tables.cut(pairs).join(some.select("key", "text").dropDuplicates(["key"]), "key").join(texts, "item").select("key", "item_id", "text", "item_text")
    found = hits.mapInArrow(_extend(window), "key binary, item_id string, hits array<int>")
    found = tables.cut(found.groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("no_id")))
    return rows.join(found, "key", "left").select(
        "key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.when(F.col("items").isNotNull(), F.size("items") + F.col("no_id")), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _contamination(docs, items, window, k, id_col, text_col, item_col, item_text_col).drop("key")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: rows whose text holds a window of a benchmark item go, whatever their doc_id; repeated rows alike."""
    out = _contamination(docs, tables.table(spark, sf_dir, "benchmark")).where("contaminated").select("key").distinct()
    return tables.without(docs, out.withColumn("one", F.lit(False)))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
       FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
dw AS (SELECT rid, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM iw), unnest(range(1, len(w) - k + 2)) AS t(p)),
m AS (SELECT rid, p, k, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + k)) AS t(q) GROUP BY rid),
x AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN x USING (rid)
"""
