"""Token counts of byte-level BPE by rank-synchronous array merging.

Texts are split into pre-tokens; the distinct ones of a batch that are not
known yet lie side by side in one ragged array of symbols. Each round finds
the lowest rank among every sequence's adjacent pairs and merges all places of
that pair in that sequence at once, in all sequences together; what symbols
survive is the count. Sequences of over LONG bytes would need a round for each
of their many ranks; theirs are taken one at a time, each rank's places from
an index that merges keep up to date. As a merge's result was learnt after its parts, this
gives what merging one pair at a time does.

Nulls and empty texts have 0 bytes and tokens. Special strings inside texts
count one token each, as the library's default has it. Repeated rows and rows
without doc_id are counted like any other; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, tables

#: Fixed: the pre-token pattern of this vocabulary's library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes from which on a pre-token is merged by itself.
LONG = 64
_NONE = np.int64(2**62)


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: the printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pre_token_pattern(spec: dict) -> str:
    """The pattern by which this vocabulary file has texts split; raises ValueError where it asks for what isn't done here."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only plain byte-level BPE is counted: no normalizer, other pattern, prefix space, word ends or other models")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("added tokens that take in what stands around them aren't counted")
    return PATTERN


class Counter:
    """Counts tokens of texts by one vocabulary file; keeps at most `most` known pre-tokens."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = pre_token_pattern(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.first[b] = vocab[c]
        self.find = regex.compile(pattern).findall
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.by_pair: dict[int, tuple[int, int]] | None = None
        self.most = most

    def merge(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        raw = [t.encode() for t in tokens]
        out = np.zeros(len(raw), np.int64)
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        if short:
            out[short] = self._together([raw[i] for i in short])
        for i, r in enumerate(raw):
            if len(r) > LONG:
                out[i] = self._long(r)
        return out

    def _long(self, raw: bytes) -> int:
        """The same for one long sequence, without a pass over the array for each rank: each rank's places are kept, by their left symbol."""
        sym = self.first[np.frombuffer(raw, np.uint8)].tolist()
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made[self.ranks].tolist())))
        pairs = self.by_pair
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            p = pairs.get(sym[i] << 32 | sym[i + 1])
            if p:
                places.setdefault(p[0], []).append(i)
        heap, left = list(places), n
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            for i in sorted(places.pop(rank)):
                j = nxt[i]
                if sym[i] < 0 or j >= n:
                    continue
                p = pairs.get(sym[i] << 32 | sym[j])
                if not p or p[0] != rank:
                    continue  # its symbols were merged meanwhile
                sym[i], sym[j] = p[1], -1
                left -= 1
                after = nxt[i] = nxt[j]
                if after < n:
                    prev[after] = i
                for a, b in ((prev[i], i), (i, after)):
                    if a >= 0 and b < n:
                        q = pairs.get(sym[a] << 32 | sym[b])
                        if q:
                            if q[0] not in places:
                                places[q[0]] = []
                                heapq.heappush(heap, q[0])
                            places[q[0]].append(a)
        return left

    def _together(self, raw: list[bytes]) -> np.ndarray:
        """Symbols that survive in each sequence, all merged in one ragged array."""
        size = np.array([len(r) for r in raw], np.int64)
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        own = np.repeat(np.arange(len(raw)), size)
        left = size.copy()
        while len(sym) > 1:
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (own[:-1] == own[1:]), self.ranks[at], _NONE)
            rank = np.append(rank, _NONE)
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
            live = low < _NONE
            hit = live & (rank == low)
            if not hit.any():
                break
            # In a run of overlapping places (a pair of equal symbols) every second one counts, from the left.
            idx = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(idx) > 1)
            run = np.arange(len(idx)) - np.maximum.accumulate(np.where(fresh, np.arange(len(idx)), 0))
            idx = idx[run % 2 == 0]
            sym[idx] = self.made[rank[idx]]
            np.subtract.at(left, own[idx], 1)
            live[idx + 1] = False  # merged into its left neighbour; sequences without a pair are done
            sym, own = sym[live], own[live]
        return left

    def counts(self, texts: list[str]) -> list[int]:
        parts, of = [], []
        for i, t in enumerate(texts):
            for p in self.special.split(t) if self.special else [t]:
                parts.append(self.find(p))
                of.append(i)
        if len(self.known) > self.most:
            self.known = {}
        fresh = list(set().union(*map(set, parts)) - self.known.keys())
        for lo in range(0, len(fresh), 50_000):
            some = fresh[lo : lo + 50_000]
            self.known.update(zip(some, self.merge(some).tolist()))
        out = [-1] * len(texts)  # one special string between two parts
        for i, p in zip(of, parts):
            out[i] += 1 + sum(map(self.known.__getitem__, p))
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; path: the vocabulary's file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path)
            for lo, hi in ragged.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                n = counter.counts([t or "" for t in part.column("text").to_pylist()])
                _, off = ragged.utf8(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(tables.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
