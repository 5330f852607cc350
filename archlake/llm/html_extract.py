"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each
with the path of open elements above it. A bidirectional LSTM reads a page's
blocks in order as hashed vectors of path and words, and so labels each with
the whole page as context; blocks labelled main text are joined. Weights are
trained here, on a bounded sample of pages whose blocks are labelled by where
they lie (article, main; not menus, asides, forms, notices or comments), half
of them remade with other markup and more boilerplate so that no single tag
decides.

Null and empty html have no text. Scripts, styles, comments and markup are no
text; character references are decoded, white space inside a block becomes one
space. Very long pages are read whole, in time that grows with their length
even where tags, quotes or elements are never closed; only training takes
their first blocks.
An svg start tag that closes itself holds nothing. Repeated rows and nulls in other
columns do no harm; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, tables

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_QUOTE = re.compile(r"[\"'>]")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: A start tag of these ends an open element of the set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

Block = tuple[str, tuple[str, ...], float]


#: Of the open elements around a block its path has the innermost ones, at most so many.
DEEPEST = 64


class _Scanner:
    """Tags of a page in order, in time that grows with its length whatever is malformed."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name (empty for comments and declarations), whether it ends an element, and attributes of the next tag; None if there is no more."""
        page, n = self.page, len(self.page)
        while True:
            lo = page.find("<", at)
            if lo < 0:
                return None
            if page.startswith(("<!--", "<![CDATA["), lo):
                end = "-->" if page[lo + 2] == "-" else "]]>"
                hi = page.find(end, lo + 4)
                return lo, n if hi < 0 else hi + 3, "", False, ""
            if page.startswith(("<!", "<?"), lo):
                hi = page.find(">", lo) if lo < self.last else -1
                return lo, n if hi < 0 else hi + 1, "", False, ""
            if lo > self.last:
                return None  # nothing closes a tag any more: the rest is text
            m = _NAME.match(page, lo)
            if not m:
                at = lo + 1
                continue
            hi = self._end(m.end())
            return lo, hi + 1, m[2].lower(), bool(m[1]), page[m.end() : hi]

    def _end(self, at: int) -> int:
        """The `>` that ends a tag: not one inside quotes, unless those don't come to an end."""
        i = at
        while self.quotes:
            m = _QUOTE.search(self.page, i)
            if m and m[0] == ">":
                return m.start()
            shut = self.page.find(m[0], m.end()) if m else -1
            if shut < 0 or shut > self.last:
                self.quotes = False  # quotes are broken from here on: they count as other characters
            i = shut + 1
        return self.page.find(">", at)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in order: text, path (elements with their classes, ids and roles), share of it inside links."""
    out: list[Block] = []
    open_: list[tuple[str, str]] = []
    count: Counter[str] = Counter()  # open elements by name
    text: list[str] = []
    linked = [0, 0]
    at, n, tags = 0, len(page), _Scanner(page)

    def flush() -> None:
        if text:
            t = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if t:
                out.append((t, tuple(x for _, x in open_[-DEEPEST:]), linked[1] / max(1, linked[0])))
            text.clear()
            linked[:] = 0, 0

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            linked[0] += len(piece)
            if count["a"]:
                linked[1] += len(piece)

    def shut(i: int) -> None:
        for name, _ in open_[i:]:
            count[name] -= 1
        del open_[i:]

    while at < n:
        tag = tags.next(at)
        if not tag:
            add(page[at:])
            break
        lo, hi, name, closes, attributes = tag
        add(page[at:lo])
        at = hi
        if not name:
            continue
        if closes:
            if name not in INLINE:
                flush()
            if count[name]:
                shut(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name))
            continue
        if name in RAW and not (name == "svg" and attributes.rstrip().endswith("/")):
            if name not in INLINE:
                flush()
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in INLINE:
            flush()
        ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if any(count[x] for x in ends):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in ends:
                    shut(i)
                    break
                if open_[i][0] in ("table", "ul", "ol", "div", "section", "article", "body"):
                    break
        if name not in VOID and not attributes.rstrip().endswith("/"):
            marks = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if attributes else ""
            open_.append((name, f"{name} {marks}".strip()))
            count[name] += 1
    flush()
    return out


PATH_DIM, WORD_DIM = 96, 32
DIM = PATH_DIM + WORD_DIM + 6
_paths: dict[tuple[str, ...], np.ndarray] = {}
_hashes: dict[str, tuple[int, float]] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _paths.get(path)
    if v is None:
        if len(_paths) > 20_000:
            _paths.clear()
        v = np.zeros(PATH_DIM, np.float32)
        for depth, node in enumerate(reversed(path)):
            for i, token in enumerate(re.split(r"[\s_-]+", node)):
                v[xxhash.xxh32_intdigest(f"{'tag' if i == 0 else 'mark'} {token}") % PATH_DIM] += 1.0 if depth < 3 else 0.5
        _paths[path] = v
    return v


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), DIM), np.float32)
    for i, (text, path, linked) in enumerate(page):
        x[i, :PATH_DIM] = _path_vector(path)
        words = _WORD.findall(text)
        for w in words:
            h = _hashes.get(w)
            if h is None:
                if len(_hashes) > 200_000:
                    _hashes.clear()
                d = xxhash.xxh32_intdigest(w.lower())
                h = _hashes[w] = (PATH_DIM + d % WORD_DIM, 1.0 if d >> 20 & 1 else -1.0)
            x[i, h[0]] += h[1]
        if words:
            v = x[i, PATH_DIM : PATH_DIM + WORD_DIM]
            v /= max(1.0, float(np.sqrt(v @ v)))
        stops = text.count(".") + text.count(",")
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(len(words)) / 4, linked, i / len(page), stops / (len(words) + 1), "©" in text, 1.0)
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.par = {}
        for d in "fb":
            self.par[f"wx{d}"] = rng.normal(0, 0.15, (DIM, 4 * hidden)).astype(np.float32)
            self.par[f"wh{d}"] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            self.par[f"b{d}"] = np.zeros(4 * hidden, np.float32)
            self.par[f"b{d}"][hidden : 2 * hidden] = 1
        self.par["wo"] = rng.normal(0, 0.15, 2 * hidden).astype(np.float32)
        self.par["bo"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True, chunk: int = 4096) -> tuple[np.ndarray, list]:
        """x: (time, pages, DIM); states stand still where mask is 0. What steps back through time need is kept only if asked for."""
        h = c = np.zeros((x.shape[1], self.hidden), np.float32)
        out, kept = np.empty((*x.shape[:2], self.hidden), np.float32), []
        k = self.hidden
        for t in range(len(x)):
            if t % chunk == 0:
                z = x[t : t + chunk] @ self.par[f"wx{d}"] + self.par[f"b{d}"]
            a = z[t % chunk] + h @ self.par[f"wh{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * k], -30, 30)))
            g = np.tanh(a[:, 3 * k :])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            m = mask[t][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if keep:
                kept.append((h, c, i, f, o, g, th))
            h, c = h2, c2
            out[t] = h
        return out, kept

    def _back(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> None:
        dh = dc = np.zeros_like(kept[0][0])
        dz = np.empty((len(x), x.shape[1], 4 * self.hidden), np.float32)
        wh, gwh = self.par[f"wh{d}"], np.zeros_like(self.par[f"wh{d}"])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, th = kept[t]
            m = mask[t][:, None]
            dh = dh + dout[t]
            dcell = m * (dh * o * (1 - th * th) + dc)
            dhm = m * dh
            dz[t] = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dhm * th * o * (1 - o), dcell * i * (1 - g * g)], 1)
            gwh += h.T @ dz[t]
            dh = dz[t] @ wh.T + (1 - m) * dh
            dc = dcell * f + (1 - m) * dc
        grad[f"wx{d}"] = np.tensordot(x, dz, ([0, 1], [0, 1]))
        grad[f"wh{d}"] = gwh
        grad[f"b{d}"] = dz.sum((0, 1))

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = max(map(len, pages))
        x, mask = np.zeros((n, len(pages), DIM), np.float32), np.zeros((n, len(pages)), np.float32)
        for i, p in enumerate(pages):
            x[: len(p), i], mask[: len(p), i] = p, 1
        return x, mask

    def _both(self, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple:
        f, kf = self._run(x, mask, "f", keep)
        b, kb = self._run(x[::-1], mask[::-1], "b", keep)
        hidden = np.concatenate([f, b[::-1]], 2)
        return hidden, kf, kb, hidden @ self.par["wo"] + self.par["bo"]

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 1) -> Labeller:
        order, rng, step = list(range(len(pages))), random.Random(seed), 0
        mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.par.items()}
        for _ in range(rounds):
            rng.shuffle(order)
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                x, mask = self._padded([pages[i] for i in some])
                y = np.zeros_like(mask)
                for j, i in enumerate(some):
                    y[: len(labels[i]), j] = labels[i]
                hidden, kf, kb, z = self._both(x, mask)
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()
                grad = {"wo": np.tensordot(hidden, dz, ([0, 1], [0, 1])), "bo": dz.sum(keepdims=True)[0]}
                dh = dz[:, :, None] * self.par["wo"]
                self._back(x, mask, "f", kf, dh[:, :, : self.hidden], grad)
                self._back(x[::-1], mask[::-1], "b", kb, dh[::-1, :, self.hidden :], grad)
                step += 1
                for k, g in grad.items():
                    a, b = mom[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.par[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length run together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) * (hi - lo + 1) < 20_000:
                hi += 1
            some = order[lo:hi]
            *_, z = self._both(*self._padded([pages[i] for i in some]), keep=False)
            for j, i in enumerate(some):
                out[i] = z[: len(pages[i]), j] > 0
            lo = hi
        return out


_MAIN = re.compile(r"^(?:article|main)\b|\b(?:article|post|entry|story)[ _-]?(?:body|content|text)\b|\bmain\b", re.I)
_NOT = re.compile(r"^(?:nav|header|footer|aside|form|menu|dialog|button|select)\b|\b(?:ads?|advert\w*|banner|sponsor\w*|promo|cookies?|consent|notice|newsletter|comments?|replies|sidebar|related|share|social|breadcrumbs?|menu|nav\w*|footer|header|login|signup|popup|modal)\b", re.I)


def placed(page: list[Block]) -> np.ndarray:
    """Labels for training: main text by where a block lies, the innermost telling element deciding."""
    return np.array([next((bool(_MAIN.search(x)) and not _NOT.search(x) for x in reversed(path) if _NOT.search(x) or _MAIN.search(x)), False) for _, path, _ in page], np.float32)


def remade(page: list[Block], label: np.ndarray, rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The page with another container around its main text and further boilerplate made of its own words."""
    box = rng.choice(["article", "main", "div content", "div post content", "section article body", "div entry content", "div article text", "main content"])
    main = [i for i, x in enumerate(label) if x]
    words = " ".join(t for t, _, _ in page).split()
    some = lambda k: " ".join(rng.choice(words) for _ in range(k)) if words else "x"
    out: list[tuple[Block, float]] = []

    def extra(kind: str, tags: list[tuple[str, ...]], count: int, length: int, linked: float) -> None:
        out.extend(((some(rng.randint(1, length)), ("html", "body", kind, *rng.choice(tags)), linked), 0.0) for _ in range(rng.randint(1, count)))

    around = rng.random() < 0.7
    if around:
        for kind, tags, count, length, linked in rng.sample([("header site header", [("h1",), ("p",), ("a",)], 2, 8, 0.3), ("nav", [("ul", "li", "a")], 8, 3, 1.0), ("div cookie notice", [("p",), ()], 2, 25, 0.1), ("div ad", [(), ("p",)], 2, 20, 0.2), ("form", [("label",), ("p",), ("button",)], 3, 6, 0.0)], 3):
            extra(kind, tags, count, length, linked)
    inside = rng.random() < 0.3
    for i, (text, path, linked) in enumerate(page):
        if not label[i]:
            out.append(((text, path, linked), 0.0))
            continue
        cut = next((j for j, x in enumerate(path) if _MAIN.search(x)), len(path))
        out.append(((text, ("html", "body", box, *path[cut + 1 :]), linked), 1.0))
        if inside and i != main[-1] and rng.random() < 0.1:
            kind = rng.choice(["div ad", "aside", "form newsletter", "div share", "aside related"])
            out.append(((some(rng.randint(1, 20)), ("html", "body", box, kind, "p"), 0.2), 0.0))
    if around:
        for kind, tags, count, length, linked in rng.sample([("aside sidebar", [("ul", "li", "a"), ("p",), ("h3",)], 6, 15, 0.6), ("section comments", [("div comment", "p"), ("h3",), ("ol", "li comment", "p")], 6, 30, 0.1), ("div related", [("ul", "li", "a")], 5, 8, 1.0), ("div newsletter", [("p",), ("form", "label")], 2, 15, 0.0), ("footer", [("p",), ("ul", "li", "a"), ()], 4, 15, 0.4)], 3):
            extra(kind, tags, count, length, linked)
    return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def learn(pages: DataFrame, most: int = 300, most_blocks: int = 2000) -> Labeller:
    """A labeller from at most `most` pages, the first by hash, each as it is and remade; of longer pages the first most_blocks blocks."""
    rows = pages.where("html is not null").select(F.xxhash64("page_id", "html").alias("h"), "html")
    ids = rows.select("h").distinct().orderBy("h").limit(most)
    some = sorted({r["h"]: r["html"] for r in rows.join(F.broadcast(ids), "h").toLocalIterator()}.items())
    rng, xs, ys = random.Random(5), [], []
    for _, page in some:
        b = blocks(page)[:most_blocks]
        y = placed(b)
        if b and y.any():
            for x, z in ((b, y), remade(b, y, rng)):
                xs.append(vectors(x))
                ys.append(z)
    return Labeller().fit(xs, ys) if xs else Labeller()


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ragged.slices(batch.column("html"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                read = [blocks(p or "") for p in part.column("html").to_pylist()]
                labels = shared.value.label([vectors(b) for b in read])
                texts = [" ".join(t for (t, _, _), y in zip(b, l.tolist()) if y) for b, l in zip(read, labels)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
