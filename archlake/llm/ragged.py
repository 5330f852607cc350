"""Vectorised words, word hashes and k-gram hashes over Arrow string columns.

A batch of texts is one byte buffer with offsets; nothing here loops over
bytes or words in Python, but for words of over LONG bytes. Word hashes are
64-bit polynomial hashes of the word's bytes, of long words xxHash (a
polynomial modulo 2**64 is weak on long regular words), k-gram hashes
polynomials of word hashes, both finished by a mixing step. They are the same
in every process. Hashes choose candidates; what follows from equal words is
decided on ids() or the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LONG = 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
TOP = np.uint64(2**64 - 1)

#: Separators `[\x20\x09-\x0D]`, and what is not `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, by byte.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array, most: int = 2 << 20, rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text and so many rows, or of one row."""
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """base**i and its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.full(self.n, b, np.uint64)) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_R), _Powers(_Q)


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (and one more)."""
    word = ~separators[data]
    brk = np.zeros(len(data) + 1, bool)
    brk[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | brk[1:-1]
    end = word
    end[:-1] &= ~word[1:] | brk[1:-1]
    ws = np.flatnonzero(start)
    return ws, np.flatnonzero(end) + 1, np.searchsorted(ws, off)


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    out, i = np.empty(len(ws), np.uint64), 0
    while i < len(ws):
        j = max(i + 1, int(np.searchsorted(we, ws[i] + piece, "right")))
        base = ws[i]
        up, down = _BYTES(int(we[j - 1] - base))
        sums = np.zeros(we[j - 1] - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base : we[j - 1]]] * up, out=sums[1:])
        a, b = ws[i:j] - base, we[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    for i in np.flatnonzero(we - ws > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[ws[i] : we[i]].tobytes())
    return out


def ids(data: np.ndarray, ws: np.ndarray, we: np.ndarray, known: dict[bytes, int], grow: bool = True) -> np.ndarray:
    """Each word's number in `known`, by its bytes; words that aren't there are added, or -1."""
    raw = data.tobytes()
    spelled = [raw[a:b] for a, b in zip(ws.tolist(), we.tolist())]
    if grow:
        for x in set(spelled) - known.keys():
            known[x] = len(known)
    get = known.get
    return np.fromiter((get(x, -1) for x in spelled), np.int64, len(spelled))


def gram_ids(x: np.ndarray, k: int) -> np.ndarray:
    """Of each x[i : i + k] a number that only equal ones share; x: numbers from 0 on."""
    g, have = x, 1
    while have < k and len(x) >= k:
        step = min(have, k - have)
        n = len(g) - step
        _, g = np.unique(g[:n] * np.int64(int(g.max(initial=0)) + 1) + g[step:], return_inverse=True)
        have += step
    return g[: max(0, len(x) - k + 1)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of h[i : i + k] for each i that has k words to come (borders of texts are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def owners(ptr: np.ndarray) -> np.ndarray:
    """For each word the text it is of."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def inside(ptr: np.ndarray, k: int) -> np.ndarray:
    """Whether k words from word i on are of one text; for the n - k + 1 first words."""
    own = owners(ptr)
    return own[: max(0, len(own) - k + 1)] == own[k - 1 :]


def sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """f over x[i : i + w] for each i, in log2(w) passes."""
    n, out, have = len(x) - w + 1, x, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        out = f(out[: len(out) - have], out[have:])
        have *= 2
    return f(out[:n], out[w - have : w - have + n])


def winnow(h: np.ndarray, ptr: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a k-gram starts that is the least of some w consecutive ones, and its hash.

    Two texts that share k + w - 1 consecutive words share such a k-gram: the
    choice depends on those words alone. All of equal least hashes are kept.
    """
    g, whole = grams(h, k), inside(ptr, k + w - 1)
    if not len(whole):
        return np.zeros(0, np.int64), g[:0]
    least = np.where(whole, sliding(np.minimum, g, w), np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    most = sliding(np.maximum, np.concatenate([pad, least, pad]), w)
    some = sliding(np.logical_or, np.concatenate([pad > 0, whole, pad > 0]), w)
    at = np.flatnonzero(some & (most == g))
    return at, g[at]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
