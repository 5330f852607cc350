"""Codecs by method number: raw bytes to packed bytes and back."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable
from functools import cache

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import legacy

#: Bytes that a member of unknown length may decode to.
MOST = 1 << 30


def _deflate(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def _inflate(data: bytes, most: int = MOST) -> bytes:
    return _whole(zlib.decompressobj(-15), data, most)


def _whole(d, data: bytes, most: int) -> bytes:
    """What d makes of the data, one byte beyond `most` at the most; raises if it ends too early."""
    out = d.decompress(data, most + 1)
    if len(out) <= most and not d.eof:
        raise ValueError("cut short")
    return out


_LZMA = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}]


def _lzma(data: bytes) -> bytes:
    return struct.pack("<BBHBI", 9, 4, 5, (2 * 5 + 0) * 9 + 3, 1 << 20) + lzma.compress(data, lzma.FORMAT_RAW, filters=_LZMA)


def _unlzma(data: bytes, most: int = MOST) -> bytes:
    n = struct.unpack_from("<H", data, 2)[0]
    props, size = data[4], struct.unpack_from("<I", data, 5)[0]
    f = [{"id": lzma.FILTER_LZMA1, "dict_size": max(size, 4096), "lc": props % 9, "lp": props // 9 % 5, "pb": props // 45}]
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=f).decompress(data[4 + n :], most + 1)


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A worker's own, as their tables take longer to make than a short text to pack."""
    return zstandard.ZstdCompressor(level=10), zstandard.ZstdDecompressor()


#: Name, packing, and unpacking to so many bytes, or to one more where there is more.
CODECS: dict[int, tuple[str, Callable[[bytes], bytes], Callable[..., bytes]]] = {
    0: ("store", bytes, lambda b, most=MOST: bytes(b[: most + 1])),
    8: ("deflate", _deflate, _inflate),
    12: ("bzip2", bz2.compress, lambda b, most=MOST: _whole(bz2.BZ2Decompressor(), b, most)),
    14: ("lzma", _lzma, _unlzma),
    93: ("zstd", lambda b: _zstd()[0].compress(b), lambda b, most=MOST: _zstd()[1].stream_reader(b).read(most + 1)),
    95: ("xz", lzma.compress, lambda b, most=MOST: _whole(lzma.LZMADecompressor(), b, most)),
}


#: Early methods, in Python and slow: packing takes (data, flags), unpacking (data, flags, length).
LEGACY: dict[int, tuple[str, Callable[[bytes, int], bytes], Callable[[bytes, int, int], bytes]]] = {
    1: ("shrink", lambda d, _: legacy.shrink(d), lambda d, _, n: legacy.unshrink(d)),
    **{m: (f"reduce-{m - 1}", lambda d, _, m=m: legacy.reduce(d, m - 1), lambda d, _, n, m=m: legacy.unreduce(d, m - 1, n)) for m in (2, 3, 4, 5)},
    6: ("implode", lambda d, f: legacy.implode(d, f), lambda d, f, n: legacy.explode(d, f, n)),
    9: ("deflate64", lambda d, _: legacy.deflate64(d), lambda d, _, n: legacy.inflate64(d)),
    10: ("dcl-implode", lambda d, _: legacy.dcl_implode(d), lambda d, _, n: legacy.dcl_explode(d)),
}
NEED_LENGTH = (2, 3, 4, 5, 6)


def encode(method: int, data: bytes, flags: int = 0) -> bytes:
    return LEGACY[method][1](data, flags) if method in LEGACY else CODECS[method][1](data)


def decode(method: int, data: bytes, flags: int = 0, length: int | None = None) -> bytes | None:
    """The member's bytes, of a longer one than its length says one byte more than that; None where the method isn't known, needs a length that isn't given, or the data is bad or too large."""
    if method == 20 and data[:4] == b"\x28\xb5\x2f\xfd":
        method = 93
    try:
        if method in LEGACY:
            return None if length is None and method in NEED_LENGTH else LEGACY[method][2](data, flags, length)
        out = CODECS[method][2](data, MOST if length is None else length)
        return None if length is None and len(out) > MOST else out
    except (KeyError, ValueError, EOFError, OSError, IndexError, zlib.error, lzma.LZMAError, struct.error, zstandard.ZstdError):
        return None


@F.pandas_udf(T.BinaryType())
def _decoded(method: pd.Series, data: pd.Series, flags: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else decode(int(m), bytes(d), int(f), None if pd.isna(n) else int(n)) for m, d, f, n in zip(method, data, flags, length)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _encoded(method: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else encode(int(m), bytes(d)) for m, d in zip(method, data)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("method", T.IntegerType()), T.StructField("csize", T.LongType()), T.StructField("ok", T.BooleanType())])))
def _sizes(data: pd.Series) -> pd.Series:
    out = []
    for d in data:
        row = []
        for m, (_, pack, unpack) in CODECS.items():
            packed = pack(bytes(d or b""))
            row.append({"method": m, "csize": len(packed), "ok": unpack(packed) == bytes(d or b"")})
        out.append(row)
    return pd.Series(out, dtype=object)


def decoded(method: Column, data: Column, flags: Column | None = None, length: Column | None = None) -> Column:
    """Members' bytes. Flags tell how imploded data was made; reduced and imploded data need their length."""
    return _decoded(method, data, F.lit(0) if flags is None else flags, F.lit(None).cast("long") if length is None else length)


def encoded(method: Column, data: Column) -> Column:
    return _encoded(method, data)


def candidate_sizes(data: Column) -> Column:
    """Of each codec: its packed size and whether it gives the bytes back."""
    return _sizes(data)
