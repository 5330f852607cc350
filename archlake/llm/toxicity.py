"""Toxic spans by a linear-chain conditional random field.

States are clean and toxic, emissions come from hashed features of the word
(itself, its beginnings and endings), transitions are learnt. Labels say only
which documents are toxic, so tokens are labelled first: in a toxic document
those with a feature that is found almost only in toxic documents. Forward and
backward run over a whole batch of texts as one chain that starts anew at each
text, in two passes over blocks, so long texts cost no more a word. The token
marginals of a text give its score through a logistic fit, and its offending
spans by offset.

Labels are learnt from at most `per_class` toxic and `clean` other documents,
the first by hash of those not held out. Null and empty texts have no tokens and get
the score of no evidence. Repeated rows score alike. Rows without doc_id are
scored and not held out. Other columns are not read.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, tables

SIZE = 1 << 18


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, beginnings of 3 to 6 and endings of 3 and 4 characters."""
    n = len(word)
    names = [f"w{word}", *(f"p{word[:i]}" for i in range(3, 7) if n >= i), *(f"s{word[-i:]}" for i in (3, 4) if n >= i)]
    return [xxhash.xxh32_intdigest(x) % SIZE for x in names]


def _chain(s: np.ndarray, start: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors (n, 2) and steps (n, 2, 2) of the chain with toxic scores s."""
    n = len(s)
    e = np.exp(np.clip(s, -30, 30))
    m = np.empty((n, 2, 2), np.float32)
    m[:] = np.exp(trans)
    m[start] = np.exp(first)  # both rows alike: what came before doesn't count
    m[:, :, 1] *= e[:, None]
    m /= m.max(axis=(1, 2), keepdims=True)
    steps = max(1, int(np.sqrt(n)))
    blocks = -(-n // steps)
    full = np.broadcast_to(np.eye(2, dtype=np.float32), (blocks * steps, 2, 2)).copy()
    full[:n] = m
    full = full.reshape(blocks, steps, 2, 2).transpose(1, 0, 2, 3).copy()
    prod = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for x in full:
        prod = prod @ x
        prod /= prod.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((blocks, 2)), np.empty((blocks, 2))
    a, b = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    for i in range(blocks):
        into[i] = a
        a = a @ prod[i]
        a /= a.sum()
    for i in range(blocks - 1, -1, -1):
        out[i] = b
        b = prod[i] @ b
        b /= b.sum()
    alpha, beta = np.empty((steps, blocks, 2), np.float32), np.empty((steps, blocks, 2), np.float32)
    for i in range(steps):
        into = np.einsum("bi,bij->bj", into, full[i])
        into /= into.sum(1, keepdims=True)
        alpha[i] = into
    for i in range(steps - 1, -1, -1):
        beta[i] = out
        out = np.einsum("bij,bj->bi", full[i], out)
        out /= out.sum(1, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return flat(alpha), flat(beta), m


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    fit: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0]))
    stamp: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_score(self, word: str) -> float:
        return self.bias + float(self.weights[features(word)].sum())

    def marginals(self, s: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0)
        start = np.zeros(len(s), bool)
        start[ptr[:-1][ptr[:-1] < ptr[1:]]] = True
        alpha, beta, _ = _chain(s, start, self.trans, self.first)
        both = alpha * beta
        return both[:, 1] / both.sum(1)

    def evidence(self, p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Of each text: 1, the log of its expected number of toxic tokens, its highest marginal."""
        sums = np.concatenate([[0.0], np.cumsum(p)])
        total = np.maximum(sums[ptr[1:]] - sums[ptr[:-1]], 0)
        most, some = np.zeros(len(ptr) - 1), np.flatnonzero(ptr[:-1] < ptr[1:])
        if len(some):
            most[some] = np.maximum.reduceat(p, ptr[some])
        return np.stack([np.ones(len(total)), np.log(total + 0.01), most], 1)

    def scores(self, p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(p, ptr) @ self.fit, -30, 30)))


def _tokens(column: pa.Array) -> tuple:
    data, off = ragged.utf8(column)
    low = ragged.LOWER[data]
    ws, we, ptr = ragged.words(low, off, ragged.NON_WORD)
    return low, off, ws, we, ptr, ragged.word_hashes(low, ws, we)


def train(texts: list[str], toxic: list[int], odds: float = 1.0, rounds: int = 50, crf_clean: int = 1000, penalty: float = 1e-3) -> Model:
    """Learns from documents' labels; odds: how often toxic ones are in the corpus, against clean ones.

    All texts tell which features are of toxic documents and fit the scores;
    the field's weights are of the toxic ones and the first crf_clean others.
    """
    model, y_doc = Model(), np.array(toxic, bool)
    low, _, ws, we, ptr, h = _tokens(pa.array(texts, pa.string()))
    if not len(h) or y_doc.all() or not y_doc.any():
        return model
    _, at, ids = np.unique(h, return_index=True, return_inverse=True)
    raw = low.tobytes()
    size, flat = [], array("q")
    for x, y in zip(ws[at].tolist(), we[at].tolist()):
        f = features(raw[x:y].decode())
        size.append(len(f))
        flat.extend(f)
    size, flat = np.array(size), np.frombuffer(flat, np.int64)
    of, n_words = np.repeat(np.arange(len(size)), size), len(size)
    own = ragged.owners(ptr)
    # In how many toxic and clean documents each feature is.
    bounds, df = np.concatenate([[0], np.cumsum(size)]), np.zeros((2, SIZE))
    for i in range(len(texts)):
        words = np.unique(ids[ptr[i] : ptr[i + 1]])
        if len(words):
            df[int(y_doc[i]), np.unique(np.concatenate([flat[bounds[w] : bounds[w + 1]] for w in words]))] += 1
    rate = (df[1] / y_doc.sum()) / (df[1] / y_doc.sum() + (df[0] + 0.5) / (~y_doc).sum())
    telling = (rate > 0.96) & (df[1] >= 4)
    word_tells = np.bincount(of, telling[flat], minlength=n_words) > 0
    y = word_tells[ids] & y_doc[own]
    start = np.zeros(len(h), bool)
    start[ptr[:-1][ptr[:-1] < ptr[1:]]] = True
    # Adam on the penalised log-likelihood.
    few = np.flatnonzero(y_doc | (np.cumsum(~y_doc) <= crf_clean))
    used = np.isin(own, few)
    ids_, y_, start_ = ids[used], y[used], start[used]
    seen_once = np.unique(flat)
    par = {"w": np.zeros(SIZE), "b": np.array([-4.0]), "t": np.zeros((2, 2)), "f": np.zeros(2)}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in par.items()}
    code = (np.roll(y_, 1).astype(int) * 2 + y_)[~start_]
    real_t, real_f = np.bincount(code, minlength=4).reshape(2, 2), np.bincount(y_[start_].astype(int), minlength=2)
    for step in range(1, rounds + 1):
        s = (par["b"] + np.bincount(of, par["w"][flat], minlength=n_words))[ids_]
        alpha, beta, m = _chain(s, start_, par["t"], par["f"])
        both = alpha * beta
        p = both[:, 1] / both.sum(1)
        xi = alpha[:-1, :, None] * m[1:] * beta[1:, None, :]
        xi = (xi / xi.sum(axis=(1, 2), keepdims=True))[~start_[1:]].sum(0)
        g = np.bincount(ids_, y_ - p, minlength=n_words)
        grad = {"w": np.bincount(flat, g[of], minlength=SIZE) - penalty * len(few) * par["w"], "b": np.array([(y_ - p).sum()]), "t": real_t - xi, "f": real_f - np.array([(1 - p[start_]).sum(), p[start_].sum()])}
        for k in par:
            a, b = mom[k]
            a += 0.1 * (grad[k] - a)
            b += 0.01 * (grad[k] ** 2 - b)
            par[k] += 0.2 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        par["w"][np.setdiff1d(np.arange(SIZE), seen_once, assume_unique=True)] = 0
    model.weights, model.bias, model.trans, model.first = par["w"], float(par["b"][0]), par["t"], par["f"]
    s = (model.bias + np.bincount(of, model.weights[flat], minlength=n_words))[ids]
    x = np.concatenate([model.evidence(model.marginals(s[ptr[i] : ptr[min(i + 200, len(texts))]], own_ptr), own_ptr) for i in range(0, len(texts), 200) for own_ptr in [ptr[i : min(i + 200, len(texts)) + 1] - ptr[i]]])
    fit = np.zeros(3)
    for _ in range(30):  # Newton's method with a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        fit = fit + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y_doc - q) - 0.5 * fit)
    fit[0] += np.log(odds * (~y_doc).sum() / y_doc.sum())
    model.fit = fit
    return model


_CACHE: dict = {}


def _word_scores(model: Model, most: int = 1 << 19):
    """Scores of a slice's words as its chain has them, with what belongs to them; keeps the scores of at most `most` words, as two arrays in order of their hashes."""
    if model.stamp not in _CACHE:
        _CACHE.clear()
        _CACHE[model.stamp] = np.zeros(0, np.uint64), np.zeros(0)  # a worker's next tasks find the words it has scored

    def marginals(column: pa.Array) -> tuple:
        low, off, ws, we, ptr, h = _tokens(column)
        uniq, at, ids = np.unique(h, return_index=True, return_inverse=True)
        known, scores = _CACHE[model.stamp]
        place = np.searchsorted(known, uniq)
        seen = np.append(known, uniq[-1:] + np.uint64(1))[place] == uniq if len(uniq) else np.zeros(0, bool)
        s, new = np.empty(len(uniq)), np.flatnonzero(~seen)
        s[seen] = scores[place[seen]]
        raw = low.tobytes()
        s[new] = [model.word_score(raw[a:b].decode()) for a, b in zip(ws[at[new]].tolist(), we[at[new]].tolist())]
        fits = len(known) + len(new) <= most
        _CACHE[model.stamp] = (np.insert(known, place[new], uniq[new]), np.insert(scores, place[new], s[new])) if fits else (uniq, s)
        p = model.marginals(s[ids] if len(h) else np.zeros(0), ptr)
        return low, off, ws, we, ptr, p

    return marginals


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        marginals = _word_scores(model)
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                low, off, ws, we, ptr, p = marginals(part.column("text"))
                score = model.scores(p, ptr)
                spans: list[list] = [[] for _ in range(len(part))]
                bad = np.flatnonzero(p >= threshold)
                if len(bad):
                    own, chars = ragged.owners(ptr)[bad], np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
                    for i, a, b in zip(own.tolist(), (chars[ws[bad]] - chars[off[own]]).tolist(), (chars[we[bad]] - chars[off[own]]).tolist()):
                        if spans[i] and b > a and spans[i][-1]["end"] + 1 >= a:
                            spans[i][-1]["end"] = b
                        else:
                            spans[i].append({"start": a, "end": b})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"])

    return run


def _clean(shared, limit: float):
    """Rows, with all their columns, whose text scores less than the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        marginals = _word_scores(model)
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                *_, ptr, p = marginals(part.column("text"))
                yield part.filter(pa.array(model.scores(p, ptr) < limit))

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 400, clean: int = 1200) -> Model:
    """A model of at most per_class toxic and `clean` other documents, none held out; the first by hash of doc_id."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = tables.cut(rows)
    count = dict(rows.groupBy("toxic").count().collect())
    some = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m) for c, m in ((0, clean), (1, per_class))]
    # per_class + clean rows at most, so they may go to all machines and their texts to the driver.
    sample = F.broadcast(some[0].unionAll(some[1]).select(F.col("doc_id").alias("id"), "toxic"))
    got: pd.DataFrame = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("id")).select("id", "text", "toxic").toPandas()
    got = got.drop_duplicates("id").sort_values("id")
    return train([t or "" for t in got["text"]], got["toxic"].tolist(), (count.get(1, 0) + 0.5) / (count.get(0, 0) + 0.5))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans (offsets in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_score(shared, threshold), "doc_id long, score double, spans array<struct<start:int,end:int>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, tables.table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents predicted toxic go; each row is judged where it is, by its text, whatever its doc_id."""
    shared = spark.sparkContext.broadcast(learn(docs, tables.table(spark, sf_dir, "labels")))
    return docs.mapInArrow(_clean(shared, 0.5), docs.schema)
