"""Near-duplicates by MinHash with tensored banding.

A text's set is its distinct shingles. Two collections of m subkeys, each of t
minhashes, give m * m tables: the key of table (i, j) joins subkey i of the
first collection with subkey j of the second. So m * m tables of 2t-minhash
keys cost 2mt minhashes instead of 2t * m * m. With m = 10 and t = 2 a pair of
similarity 0.8 shares a key with probability (1 - (1 - 0.8**2)**10)**2 =
0.99993. A key that two texts share needs both its subkeys shared, so the 2m
subkeys of each text are counted first and only those that occur again are
combined.

Texts of equal sets are one node. Each bucket's nodes are tried against two
of its own, the first and the last by a hash, pairs are
confirmed on the shingles of whole texts, by their words, and confirmed links
give components. Then every bucket that still holds several components has its
pairs across them tried, so each candidate pair was either tested or already
connected: there is no cap on buckets.

Such a pair may meet in many buckets; it counts in those of the first subkey
that its sets share in the first collection. Pairs are tried only if they pass
an exact filter: each set has a bitmap of parities, a bit for each residue of
its shingles, and two sets differ in at least as many shingles as their
bitmaps differ in bits.

Null and empty texts have an empty set and stand alone. Rows that are
repeated share a node. Rows without doc_id never name a component; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, ragged, tables
from .components import components

#: Of a set's parity bitmap; a multiple of 64.
BITS = 512
#: Orders of a nodes: by the distance of their hash, as XOR, from these.
ORDERS = (0, -1)


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, as (text, hash) in order; shorter texts have one of all their words."""
    data, off = ragged.utf8(column)
    data = ragged.LOWER[data]
    ws, we, ptr = ragged.words(data, off, ragged.SPACES)
    h = ragged.word_hashes(data, ws, we)
    own, whole = ragged.owners(ptr), ragged.inside(ptr, k)
    own, g = own[: len(whole)][whole], ragged.grams(h, k)[whole]
    n = np.diff(ptr)
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        own = np.concatenate([own, short])
        g = np.concatenate([g, ragged.grams(h, m)[ptr[short]]]) if len(short) else g
    order = np.lexsort((g, own))
    own, g = own[order], g[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (g[1:] != g[:-1])
    return own[fresh], g[fresh]


class Signer:
    """m subkeys of t minhashes in each of two collections."""

    def __init__(self, m: int, t: int):
        rng = np.random.default_rng(11)
        self.m, self.t = m, t
        self.mul = rng.integers(1, 2**63, (2 * m * t, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, g: np.ndarray, heads: np.ndarray) -> np.ndarray:
        out = np.zeros((len(heads), 2 * self.m), np.uint64)
        for i, (a, b) in enumerate(self.mul):
            v = (g ^ b) * a
            v ^= v >> np.uint64(29)
            v *= b
            c = i // self.t
            out[:, c] = ragged.mix(out[:, c] + np.minimum.reduceat(v, heads))
        return out


def _summaries(k: int, m: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(m, t)
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text"), 1 << 20, 2048):
                part = batch.slice(lo, hi - lo)
                own, g = shingles(part.column("text"), k)
                n = np.bincount(own, minlength=len(part))
                sums = np.zeros((2, len(part)), np.uint64)
                sig = np.zeros((len(part), 2 * m), np.uint64)
                odd = (np.bincount(own * BITS + (g >> np.uint64(40)).astype(np.int64) % BITS, minlength=len(part) * BITS) & 1).astype(bool)
                bits = np.packbits(odd.reshape(len(part), BITS), axis=1, bitorder="little").view(np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    heads = np.searchsorted(own, some)
                    sums[0, some] = np.add.reduceat(g, heads)
                    sums[1, some] = np.add.reduceat(ragged.mix(g ^ ragged.TOP), heads)
                    sig[some] = sign(g, heads)
                half = (sig >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((half, pa.int32()), (bits, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(ragged.signed(s)) for s in sums), *lists], ["key", "doc_id", "n", "s1", "s2", "sig", "bits"])

    return run


def _numbered(column: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text where its words begin, and all words' numbers."""
    data, off = ragged.utf8(column)
    data = ragged.LOWER[data]
    ws, we, ptr = ragged.words(data, off, ragged.SPACES)
    return ptr, ragged.ids(data, ws, we, known)


def _confirm(k: int, percent: int):
    """Pairs whose shingles, compared by their words, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("ta"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                known: dict[bytes, int] = {}
                (ptr_a, xa), (ptr_b, xb) = (_numbered(part.column(c), known) for c in ("ta", "tb"))
                # Both sides' words in one array, so equal shingles get one number; those of texts shorter than k stand apart by length.
                x, ptr = np.concatenate([xa, xb]), np.concatenate([ptr_a, ptr_b[1:] + len(xa)])
                owner, n = ragged.owners(ptr) % max(1, len(part)), np.diff(ptr)
                whole = np.flatnonzero(ragged.inside(ptr, k))
                owns, grams, base = [owner[whole]], [ragged.gram_ids(x, k)[whole]], len(x) + 1
                for m in range(1, k):
                    short = ptr[:-1][n == m]
                    if len(short):
                        owns.append(owner[short])
                        grams.append(ragged.gram_ids(x, m)[short] + m * base)
                own, g = np.concatenate(owns), np.concatenate(grams)
                left = np.concatenate([whole, *(ptr[:-1][n == m] for m in range(1, k))]) < len(xa)
                order = np.lexsort((g, left, own))
                own, g, left = own[order], g[order], left[order]
                fresh = np.append(True, (own[1:] != own[:-1]) | (g[1:] != g[:-1]) | (left[1:] != left[:-1]))[: len(own)]
                own, g = own[fresh], g[fresh]
                order = np.lexsort((g, own))
                own, g = own[order], g[order]
                both = np.bincount(own[1:][(own[1:] == own[:-1]) & (g[1:] == g[:-1])], minlength=len(part))
                union = np.bincount(own, minlength=len(part)) - both
                ok = pa.array((both > 0) & (100 * both >= percent * union))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])

    return run


def _grouped(docs: DataFrame, shingle: int, percent: int, m: int, t: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key, doc_id, n_shingles, component_id, keep_key (one row's key in each component, of those with component_id)."""
    docs = docs.select(tables.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = tables.cut(docs.mapInArrow(_summaries(shingle, m, t), "key binary, doc_id long, n long, s1 long, s2 long, sig array<int>, bits array<long>"))
    some = rows.where("n > 0")
    # A node: all rows of one set, numbered as the table is written.
    top = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("top")
    sets = tables.cut(some.groupBy("n", "s1", "s2").agg(top, F.any_value("sig").alias("sig"), F.any_value("bits").alias("bits")).withColumn("node", F.monotonically_increasing_id()))
    # Subkeys that occur again, then the tables' keys of those alone.
    subkeys = sets.select("node", F.posexplode("sig").alias("c", "x")).select("node", "c", F.xxhash64("c", "x").alias("h"))
    again = tables.cut(subkeys.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))
    held = subkeys.join(again, "h", "left_semi").groupBy("node").agg(F.collect_list(F.struct("c", "h")).alias("own"))
    held = tables.cut(held.where(F.exists("own", lambda x: x["c"] < m) & F.exists("own", lambda x: x["c"] >= m)))
    one = held.select("node", F.explode("own").alias("a"), "own").where(F.col("a.c") < m)
    keys = one.select("node", F.col("a.c").cast("byte").alias("i"), F.col("a.h").alias("x"), F.explode(F.filter("own", lambda x: x["c"] >= m)).alias("b")).select(F.xxhash64("x", "b.h").alias("bucket"), "node", "i")
    heads = tables.cut(keys.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket"))
    members = tables.cut(keys.join(heads, "bucket", "left_semi").select("bucket", "node", "i"))
    tables.drop(again, held, heads)
    # What two sets may differ in at most: similarity s, |x| + |y| = t shingles, t * (1 - s) / (1 + s) of them in one only.
    words = range(BITS // 64)
    sub = lambda i: F.col("sig")[i].cast("long").bitwiseAND(0xFFFFFFFF)
    packed = [F.shiftleft(sub(i), 32).bitwiseOR(sub(i + 1) if i + 1 < m else F.lit(0)).alias(f"p{i // 2}") for i in range(0, m, 2)]
    marks = tables.cut(sets.join(tables.cut(members.select("node").distinct()), "node", "left_semi").select("node", "n", F.col("top.key").alias("key"), *(F.col("bits")[i].alias(f"b{i}") for i in words), *packed))
    of_sets = tables.cut(sets.select("n", "s1", "s2", "top", "node"))
    tables.drop(sets)
    differ = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o{i}"))) for i in words), F.lit(0))
    fits = lambda x, y: (F.lit(percent) * F.greatest(x, y) <= F.lit(100) * F.least(x, y)) & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (x + y))
    mark = marks.drop("key")
    other = mark.select(F.col("node").alias("node2"), F.col("n").alias("n2"), *(F.col(f"b{i}").alias(f"o{i}") for i in words), *(F.col(f"p{i}").alias(f"q{i}") for i in range(len(packed))))
    half = lambda c, i: F.shiftrightunsigned(F.col(f"{c}{i // 2}"), 32) if i % 2 == 0 else F.col(f"{c}{i // 2}").bitwiseAND(0xFFFFFFFF)
    first_shared = F.lit(m)
    for i in range(m - 1, -1, -1):
        first_shared = F.when(half("p", i) == half("q", i), i).otherwise(first_shared)

    def filtered(pairs: DataFrame) -> DataFrame:
        """pairs: node, node2. Those that may be links, as a and b."""
        return pairs.join(mark, "node").join(other, "node2").where(fits(F.col("n"), F.col("n2"))).select(F.col("node").alias("a"), F.col("node2").alias("b"))

    first_by = lambda c: F.min_by("node", F.xxhash64("node").bitwiseXOR(c))
    leads = tables.cut(members.groupBy("bucket").agg(F.array_distinct(F.array(*map(first_by, ORDERS))).alias("leads")))
    tried = members.join(leads, "bucket").select("node", F.explode("leads").alias("lead")).where("node <> lead")
    pairs = tables.cut(tried.select(F.least("node", "lead").alias("node"), F.greatest("node", "lead").alias("node2")).distinct())
    first = tables.cut(filtered(pairs))
    tables.drop(leads, pairs)
    texts = bitmaps.sieve(docs.select("key", F.xxhash64("key").alias("h"), "text"), "h", bitmaps.build(marks.select(F.xxhash64("key").alias("h"))))
    texts = tables.cut(texts.select("key", "text").join(marks.select("key", "node"), "key").dropDuplicates(["node"]).select("node", "text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        return tables.cut(with_b.mapInArrow(_confirm(shingle, percent), "a long, b long"))

    links = confirmed(first)
    label = tables.cut(components(links))
    # Buckets that still hold several components: pairs across them that weren't tested.
    held = tables.cut(members.join(label, "node", "left").select("bucket", "node", "i", F.coalesce("component", "node").alias("c")))
    open_ = tables.cut(held.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("bucket"))
    left = tables.cut(held.join(open_, "bucket", "left_semi").join(mark, "node"))
    tables.drop(members, held, open_)
    right = left.select("bucket", F.col("c").alias("c2"), F.col("node").alias("node2")).join(other, "node2")
    across = left.join(right, "bucket").where((F.col("c") < F.col("c2")) & fits(F.col("n"), F.col("n2")) & (first_shared == F.col("i")))
    across = across.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    rest = tables.cut(across.join(first, ["a", "b"], "left_anti"))
    tables.drop(left, first, marks)
    if rest.take(1):
        more = confirmed(rest)
        if more.take(1):
            links = links.unionByName(more)
            label = tables.cut(components(links))
    tables.drop(rest, texts)
    # Of each component the least doc_id of all its documents.
    named = tables.cut(of_sets.join(label, "node", "left").select("n", "s1", "s2", "top", F.coalesce("component", "node").alias("c")))
    least = tables.cut(named.groupBy("c").agg(F.min("top").alias("top")).select("c", F.col("top.doc_id").alias("component_id"), F.col("top.key").alias("keep_key")))
    named = tables.cut(named.join(least, "c").select("n", "s1", "s2", "component_id", "keep_key"))
    tables.drop(of_sets, least)
    out = some.join(named, ["n", "s1", "s2"]).select("key", "doc_id", F.col("n").alias("n_shingles"), "component_id", "keep_key")
    none = rows.where("n = 0").select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("key").alias("keep_key"))
    return out.unionByName(none)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, m: int = 10, t: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    out = _grouped(docs, shingle, percent, m, t, id_col, text_col).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables.table(spark, sf_dir, "documents"), shingle=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near-duplicates (five-word shingles, 0.8) one row stays, one with the least doc_id; one without doc_id only if none has any. Of identical rows one stays, texts without words too."""
    return tables.kept(docs, _grouped(docs, shingle=5, percent=80, m=10, t=2))
