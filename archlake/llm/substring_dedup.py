"""Removal of passages that repeat anywhere in the corpus, by repeated-phrase automata.

A passage repeats when `window` consecutive words also start somewhere else.

Candidates come from hashes. Of each window's k-word phrases the least by hash
is an anchor, so a window's two occurrences have a common anchor; only windows
around anchors that occur twice are counted, by 96 bits of hash. Each window
that seems to repeat gets a home, one of its occurrences; homes lie in pieces
of PIECE windows of a document, and each other document learns which pieces it
may share a window with.

Passages are confirmed on words. Each batch of documents compiles Aho-Corasick
automata of the phrases of its pieces, as the pieces' home documents spell
them, a bounded number each; every window of a piece holds one of those
phrases. The documents are streamed through, each occurrence of a phrase is
extended over the piece's words, and windows that agree word by word count for
the document and, as a bit of the piece, for the home. Nothing is removed that
the automata didn't find.

Texts are sent only if a bitmap says that they may hold a recurring anchor; the
others are finished where they lie. Null and empty texts have no words and
stay empty. Repeated rows repeat each other's passages. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, ragged, tables

#: Windows of a piece: as many as a long has bits.
PIECE = 64


def _tokens(column: pa.Array) -> tuple:
    data, off = ragged.utf8(column)
    ws, we, ptr = ragged.words(data, off, ragged.SPACES)
    return data, off, ws, we, ptr


def _lists(own: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    """Columns as a list for each of n rows; own: ascending rows."""
    ends = pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]


def _anchors(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                data, off, ws, we, ptr = _tokens(part.column("text"))
                at, fp = ragged.winnow(ragged.word_hashes(data, ws, we), ptr, k, w)
                own = ragged.owners(ptr)[at]
                order = np.lexsort((fp, own))
                own, fp = own[order], fp[order]
                head = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (fp[1:] != fp[:-1]))) if len(fp) else np.zeros(0, np.int64)
                lists = _lists(own[head], len(part), ragged.signed(fp[head]), np.diff(np.append(head, len(fp))).astype(np.int32))
                raw = data.tobytes()
                shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(np.diff(ptr)), pa.array(shas), *lists], ["key", "doc_id", "n_words", "sha", "fps", "counts"])

    return run


def _windows(window: int, k: int, w: int):
    """Windows around recurring anchors: their document, first word, and 96 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                data, _, ws, we, ptr = _tokens(part.column("text"))
                h, own = ragged.word_hashes(data, ws, we), ragged.owners(ptr)
                at, fp = ragged.winnow(h, ptr, k, w)
                fps = part.column("fps").flatten().to_numpy()
                at = at[np.isin(ragged.signed(fp), np.unique(fps))]
                cover = np.zeros(len(h) + 1, np.int64)
                first, last = np.maximum(at - (w - 1), ptr[own[at]]), np.minimum(at, ptr[own[at] + 1] - window)
                ok = first <= last
                np.add.at(cover, first[ok], 1)
                np.add.at(cover, last[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                g = ragged.grams(h, window)[at] if len(at) else np.zeros(0, np.uint64)
                more = ragged.grams(ragged.mix(h ^ ragged.TOP), window)[at] if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("num").take(pa.array(own[at])), pa.array((at - ptr[own[at]]).astype(np.int32)), pa.array(ragged.signed(g)), pa.array((more >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["num", "at", "h", "g"])

    return run


def _spell(window: int):
    """The words of a document's pieces, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nums, pieces, texts = [], [], []
            for num, text, own in zip(batch.column("num").to_pylist(), batch.column("text").to_pylist(), batch.column("pieces").to_pylist()):
                words = text.encode().split()
                for b in own:
                    nums.append(num)
                    pieces.append(b)
                    texts.append(b" ".join(words[b * PIECE : (b + 1) * PIECE + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(nums, pa.int64()), pa.array(pieces, pa.int32()), pa.array(texts, pa.string())], ["home", "piece", "words"])

    return run


def _coded(x: np.ndarray) -> str:
    """Words' numbers as three letters each, of three alphabets, so that a match begins where a word does; no word is -1."""
    x = x + 1
    out = np.empty((len(x), 3), np.uint32)
    out[:, 0], out[:, 1], out[:, 2] = 0x100 + (x >> 14), 0x1000 + (x >> 7 & 127), 0x2000 + (x & 127)
    return out.tobytes().decode("utf-32-le")


def occurrences(texts: list[np.ndarray], phrases: list[np.ndarray], of: list[list[int]], per_automaton: int = 20_000) -> Iterator[tuple[int, int, int]]:
    """(text, phrase, first word) of every place at which one of its phrases lies in a text; all are words' numbers. of: each text's phrases, by number."""
    coded = [_coded(t) for t in texts]
    lo = 0
    while lo < len(phrases):
        hi = min(len(phrases), lo + per_automaton)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for j in range(lo, hi):
            automaton.add_word(_coded(phrases[j]), j)
        automaton.make_automaton()
        for i, own in enumerate(of):
            mine = {j for j in own if lo <= j < hi}
            if mine:
                for end, j in automaton.iter(coded[i]):
                    if j in mine:
                        yield i, j, (end + 1) // 3 - len(phrases[j])
        lo = hi


def _find(window: int, k: int):
    """For each document: masks of windows, from word `at` on, that agree with a piece; for each such piece the same at its home."""
    step = window - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text"), 1 << 20, 1024):
                part = batch.slice(lo, hi - lo)
                known: dict[bytes, int] = {}
                shared = part.column("shared").to_pylist()
                pieces: dict[tuple, int] = {}
                spelled: list[np.ndarray] = []
                for own in shared:
                    for p in own:
                        if (p["home"], p["piece"]) not in pieces:
                            pieces[p["home"], p["piece"]] = len(spelled)
                            words = p["words"].encode().split(b" ")
                            for x in words:
                                if x not in known:
                                    known[x] = len(known)
                            spelled.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                names = list(pieces)
                # Phrases of k words: one in every window of a piece.
                number: dict[bytes, int] = {}
                phrases: list[np.ndarray] = []
                held: list[list[tuple[int, int]]] = []
                for x in spelled:
                    starts = sorted({*range(0, len(x) - k + 1, step), len(x) - k})
                    own_phrases = []
                    for s in starts:
                        j = number.setdefault(x[s : s + k].tobytes(), len(phrases))
                        if j == len(phrases):
                            phrases.append(x[s : s + k])
                        own_phrases.append((j, s))
                    held.append(own_phrases)
                data, _, ws, we, ptr = _tokens(part.column("text"))
                ids = ragged.ids(data, ws, we, known, grow=False)
                texts = [ids[a:b] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
                places: list[dict[int, list[tuple[int, int]]]] = []
                for own in shared:
                    by: dict[int, list[tuple[int, int]]] = {}
                    for p in own:
                        q = pieces[p["home"], p["piece"]]
                        for j, s in held[q]:
                            by.setdefault(j, []).append((q, s))
                    places.append(by)
                wanted = {(i, pieces[p["home"], p["piece"]], s) for i, own in enumerate(shared) for p in own for s in p["starts"]}
                masks: dict[tuple[int, int], int] = {}
                nums = part.column("num").to_pylist()
                for i, j, at in occurrences(texts, phrases, [list(by) for by in places]):
                    for q, s in places[i][j]:
                        start = at - s  # where the piece's first word would lie
                        if (i, q, start) not in wanted:
                            continue
                        wanted.discard((i, q, start))
                        x, t = spelled[q], texts[i]
                        a, b = max(0, -start), min(len(x), len(t) - start)
                        if b - a < window:
                            continue
                        run_ = np.concatenate([[0], np.cumsum(x[a:b] != t[start + a : start + b])])
                        whole = np.flatnonzero(run_[window:] == run_[:-window]) + a
                        if len(whole):
                            mask = int(np.bitwise_or.reduce(np.uint64(1) << whole.astype(np.uint64)))
                            home, piece = names[q]
                            for place in ((nums[i], start), (home, piece * PIECE)):
                                masks[place] = masks.get(place, 0) | mask
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in masks], pa.int64()), pa.array([x for _, x in masks], pa.int32()), pa.array(np.array([*masks.values()], np.uint64).view(np.int64))], ["num", "at", "mask"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.arange(PIECE, dtype=np.uint64)
        for batch in batches:
            removed, shas = [], []
            for text, masks in zip(batch.column("text").to_pylist(), batch.column("masks").to_pylist()):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                at = np.array([m["at"] for m in masks], np.int64)
                bits = np.array([m["mask"] for m in masks], np.int64).view(np.uint64)
                i, j = np.nonzero(bits[:, None] >> bit & np.uint64(1))
                s = np.unique(at[i] + j)
                gone[s] += 1
                np.add.at(gone, s + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(x for x, g in zip(words, gone.tolist()) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["key", "n_removed", "kept_sha256"])

    return run


def repeated_passages(docs: DataFrame, window: int = 35, k: int = 16, phrase: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256. k: words of an anchor; phrase: words of the automata's phrases."""
    w = window - k + 1
    docs = docs.select(tables.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = tables.cut(docs.mapInArrow(_anchors(k, w), "key binary, doc_id long, n_words long, sha string, fps array<long>, counts array<int>"))
    anchors = rows.select("key", F.explode(F.arrays_zip("fps", "counts")).alias("x")).select("key", F.col("x.fps").alias("fp"), F.col("x.counts").alias("c"))
    again = tables.cut(anchors.groupBy("fp").agg(F.sum("c").alias("n")).where("n > 1").select("fp"))
    of_doc = tables.cut(anchors.join(again, "fp", "left_semi").groupBy("key").agg(F.collect_set("fp").alias("fps")))
    tables.drop(again)
    # Texts that may hold a recurring anchor, numbered as they are written.
    sieved = bitmaps.sieve(docs.select("key", F.xxhash64("key").alias("h"), "text"), "h", bitmaps.build(of_doc.select(F.xxhash64("key").alias("h"))))
    held = tables.cut(sieved.select("key", "text").join(of_doc, "key").withColumn("num", F.monotonically_increasing_id()))
    tables.drop(of_doc)
    windows = held.select("num", "text", "fps").mapInArrow(_windows(window, k, w), "num long, at int, h long, g int")
    twice = tables.cut(windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("num").alias("home"), F.min_by("at", "num").alias("home_at")).where("n > 1").select("h", "g", "home", "home_at"))
    # Which pieces of which homes a document may share windows with, and where a piece's first word would lie in it.
    hits = windows.join(twice, ["h", "g"]).where((F.col("num") != F.col("home")) | (F.col("at") != F.col("home_at")))
    routes = hits.select("num", "home", F.expr(f"cast(home_at div {PIECE} as int)").alias("piece"), F.expr(f"at - home_at % {PIECE}").alias("start")).distinct()
    routes = tables.cut(routes.groupBy("num", "home", "piece").agg(F.collect_list("start").alias("starts")))
    tables.drop(twice)
    homes = routes.groupBy(F.col("home").alias("num")).agg(F.collect_set("piece").alias("pieces"))
    spelled = tables.cut(held.select("num", "text").join(homes, "num").mapInArrow(_spell(window), "home long, piece int, words string"))
    shared = routes.join(spelled, ["home", "piece"]).groupBy("num").agg(F.collect_list(F.struct("home", "piece", "words", "starts")).alias("shared"))
    found = held.select("num", "text").join(shared, "num").mapInArrow(_find(window, phrase), "num long, at int, mask long")
    masks = tables.cut(found.groupBy("num", "at").agg(F.bit_or("mask").alias("mask")).groupBy("num").agg(F.collect_list(F.struct("at", "mask")).alias("masks")))
    tables.drop(routes, spelled)
    changed = held.select("num", "key", "text").join(masks, "num").select("key", "text", "masks").mapInArrow(_remove(window), "key binary, n_removed long, kept_sha256 string")
    changed = tables.cut(changed.dropDuplicates(["key"]))
    tables.drop(held, masks)
    out = rows.select("key", "doc_id", "n_words", "sha").join(changed, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(tables.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, p, sha256(array_to_string(w[p : p + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(p)),
r AS (SELECT rid, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
c AS (SELECT rid, list(DISTINCT q) AS gone FROM r, unnest(range(p, p + 35)) AS t(q) GROUP BY rid),
k AS (SELECT d.rid, string_agg(w[q], ' ' ORDER BY q) AS kept FROM d JOIN c USING (rid), unnest(range(1, len(w) + 1)) AS t(q) WHERE NOT list_contains(gone, q) GROUP BY d.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
