"""Members' encryption: the old stream cipher and AES in its first two forms.

Passwords are arguments, never columns. What a password doesn't open is null.
"""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import os
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 12  # bytes that the old cipher puts before the data
TAG = 10


class Refused(ValueError):
    """The password is wrong or the data changed."""


@cache
def _crc_steps() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


class _Stream:
    """Three keys that every plain byte moves on."""

    def __init__(self, password: bytes):
        self.keys = (0x12345678, 0x23456789, 0x34567890)
        for b in password:
            self.move(b)

    def move(self, b: int) -> None:
        a, c, e = self.keys
        step = _crc_steps()
        a = a >> 8 ^ step[(a ^ b) & 255]
        c = ((c + (a & 255)) * 134775813 + 1) & 0xFFFFFFFF
        self.keys = a, c, e >> 8 ^ step[(e ^ c >> 24) & 255]

    def next(self) -> int:
        t = self.keys[2] & 0xFFFF | 2
        return t * (t ^ 1) >> 8 & 255

    def run(self, data: bytes, opening: bool) -> bytes:
        out = bytearray(len(data))
        for i, x in enumerate(data):
            out[i] = x ^ self.next()
            self.move(out[i] if opening else x)
        return bytes(out)


def old_decrypt(data: bytes, password: bytes, check: int) -> bytes:
    """check: the byte that the head must end with."""
    s = _Stream(password)
    if len(data) < HEAD or s.run(data[:HEAD], True)[-1] != check:
        raise Refused("wrong password")
    return s.run(data[HEAD:], True)


def old_encrypt(data: bytes, password: bytes, check: int, noise: bytes | None = None) -> bytes:
    s = _Stream(password)
    return s.run((noise or os.urandom(HEAD - 1))[: HEAD - 1] + bytes([check]) + data, False)


@cache
def _box() -> np.ndarray:
    """The cipher's substitution: the inverse in GF(2^8), then bits folded."""
    power, x = [], 1
    for _ in range(255):
        power.append(x)
        x ^= x << 1
        x = (x ^ 0x11B if x & 256 else x) & 255
    log = {v: i for i, v in enumerate(power)}
    out = []
    for v in range(256):
        b = power[-log[v] % 255] if v else 0
        y = 0x63
        for turn in range(5):
            y ^= (b << turn | b >> 8 - turn) & 255
        out.append(y)
    return np.array(out, np.uint8)


@cache
def _mixed() -> list[np.ndarray]:
    """What a byte in each row of a column adds to the column after substitution and mixing, as words."""
    s = _box()
    twice = (s << 1) ^ (s >> 7) * np.uint8(0x1B)
    column = [twice, s, s, twice ^ s]
    return [np.stack([column[(i - r) % 4] for i in range(4)], 1).copy().view("<u4")[:, 0] for r in range(4)]


def _round_keys(keys: np.ndarray) -> np.ndarray:
    """Round by round, the keys of each row of bytes."""
    box, n = _box(), keys.shape[1] // 4
    words, rcon = [keys[:, 4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = box[np.roll(w, -1, 1)]
            w[:, 0] ^= np.uint8(rcon)
            rcon = (rcon << 1 ^ (0x11B if rcon & 128 else 0)) & 255
        elif n > 6 and i % n == 4:
            w = box[w]
        words.append(words[i - n] ^ w)
    return np.stack(words, 1).reshape(len(keys), -1, 16).transpose(1, 0, 2).copy()


def _encrypted_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """keys: round by round, those of each block or of all."""
    box, mixed = _box(), _mixed()
    rows = np.array([[(4 * (c + r) + r) % 16 for c in range(4)] for r in range(4)])
    x = blocks ^ keys[0]
    for k in keys[1:-1]:
        w = mixed[0][np.take(x, rows[0], 1)]
        for r in (1, 2, 3):
            w ^= mixed[r][np.take(x, rows[r], 1)]
        x = w.view(np.uint8) ^ k
    return box[np.take(x, rows.T.reshape(-1), 1)] ^ keys[-1]


def aes_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """Encrypts rows of 16 bytes, all at once."""
    return _encrypted_blocks(_round_keys(np.frombuffer(key, np.uint8)[None]), blocks)


#: Blocks that are encrypted at a time.
_AT_ONCE = 4096


def _all_counted(keys: list[bytes], data: list[bytes]) -> list[bytes]:
    """Each text against the numbers 1, 2, ... in little-endian blocks, encrypted by its key. Keys are of one length."""
    if not keys:
        return []
    rounds = _round_keys(np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1))
    n = np.array([-(-len(d) // 16) for d in data])
    ends = np.cumsum(n)
    whose, total = np.repeat(np.arange(len(data)), n), int(ends[-1])
    numbers = np.arange(1, total + 1) - np.repeat(ends - n, n)
    pad = np.empty((total, 16), np.uint8)
    for lo in range(0, total, _AT_ONCE):
        of = whose[lo : lo + _AT_ONCE]
        blocks = np.zeros((len(of), 16), np.uint8)
        blocks[:, :8] = numbers[lo : lo + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        pad[lo : lo + _AT_ONCE] = _encrypted_blocks(np.take(rounds, of, 1), blocks)
    flat = pad.reshape(-1)
    return [(flat[16 * (e - k) : 16 * (e - k) + len(d)] ^ np.frombuffer(d, np.uint8)).tobytes() for e, k, d in zip(ends.tolist(), n.tolist(), data)]


def _counted(key: bytes, data: bytes) -> bytes:
    return _all_counted([key], [data])[0]


def _aes_keys(password: bytes, salt: bytes, strength: int) -> tuple[bytes, bytes, bytes]:
    size = 8 + 8 * strength
    k = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * size + 2)
    return k[:size], k[size : 2 * size], k[2 * size :]


def _aes_checked(data: bytes, password: bytes, strength: int) -> tuple[bytes, bytes]:
    """The key and the data under it, once the tag has been checked."""
    size = 4 + 4 * strength
    if strength not in (1, 2, 3) or len(data) < size + 2 + TAG:
        raise Refused("not of this form")
    key, seal, check = _aes_keys(password, data[:size], strength)
    body = data[size + 2 : -TAG]
    if check != data[size : size + 2] or not hmac.compare_digest(hmac.new(seal, body, hashlib.sha1).digest()[:TAG], data[-TAG:]):
        raise Refused("wrong password or changed data")
    return key, body


def aes_decrypt(data: bytes, password: bytes, strength: int) -> bytes:
    """strength 1 to 3: keys of 128, 192 or 256 bits. The tag is checked before anything is opened."""
    return _counted(*_aes_checked(data, password, strength))


def aes_encrypt_all(data: list[bytes], password: bytes, strength: int = 3, salts: list[bytes] | None = None) -> list[bytes]:
    """Each text sealed by itself, under a salt of its own."""
    salts = salts or [os.urandom(4 + 4 * strength) for _ in data]
    keys = [_aes_keys(password, salt, strength) for salt in salts]
    bodies = _all_counted([k for k, _, _ in keys], data)
    return [salt + check + body + hmac.digest(seal, body, "sha1")[:TAG] for salt, (_, seal, check), body in zip(salts, keys, bodies)]


def aes_encrypt(data: bytes, password: bytes, strength: int = 3, salt: bytes | None = None) -> bytes:
    return aes_encrypt_all([data], password, strength, [salt] if salt else None)[0]


def _check_byte(flags: int, crc: int, packed: int) -> int:
    """The time's high byte where sizes follow the data, else the checksum's."""
    return packed >> 8 & 255 if flags & 8 else crc >> 24 & 255


def decrypted(payloads: DataFrame, password: bytes) -> DataFrame:
    """Payloads with the encrypted ones opened: null where the password doesn't fit. Others stay."""

    @F.pandas_udf(T.BinaryType())
    def opened(data: pd.Series, flags: pd.Series, crc: pd.Series, packed: pd.Series, strength: pd.Series, version: pd.Series) -> pd.Series:
        out, by_strength = [None] * len(data), {}
        for i, (d, f, c, t, s, v) in enumerate(zip(data, flags, crc, packed, strength, version)):
            with contextlib.suppress(Refused):
                if d is not None and v in (1, 2):
                    checked = _aes_checked(bytes(d), password, int(s))
                    by_strength.setdefault(int(s), []).append((i, *checked))
                elif d is not None and not v:
                    out[i] = old_decrypt(bytes(d), password, _check_byte(int(f), int(c), int(t)))
        for some in by_strength.values():
            at, keys, bodies = zip(*some)
            for i, plain in zip(at, _all_counted(list(keys), list(bodies))):
                out[i] = plain
        return pd.Series(out, dtype=object)

    plain = opened("payload", "flags", "crc", "dos_datetime", "aes_strength", "aes_version")
    return payloads.withColumn("payload", F.when(F.col("encrypted"), plain).otherwise(F.col("payload"))).withColumn("encrypted", F.col("encrypted") & F.col("payload").isNull())


def encrypted(rows: DataFrame, password: bytes, strength: int = 3) -> DataFrame:
    """A writer's rows with their payloads sealed by AES, second form (strength 1 to 3), or by the old cipher (0); directories stay."""

    @F.pandas_udf(T.BinaryType())
    def sealed(data: pd.Series, crc: pd.Series) -> pd.Series:
        texts = [bytes(d) for d in data]
        return pd.Series(aes_encrypt_all(texts, password, strength) if strength else [old_encrypt(d, password, int(c) >> 24 & 255) for d, c in zip(texts, crc)], dtype=object)

    file = ~F.col("name").endswith("/")
    flags = F.coalesce(F.col("flags"), F.lit(0)) if "flags" in rows.columns else F.lit(0)
    out = rows.withColumn("payload", F.when(file, sealed("payload", "crc")).otherwise(F.col("payload"))).withColumn("flags", flags.bitwiseOR(F.when(file, 1).otherwise(0)))
    if strength:
        field = F.concat(F.lit(bytes([0x01, 0x99, 7, 0, 2, 0]) + b"AE" + bytes([strength])), F.unhex(F.lpad(F.hex(F.col("method").bitwiseAND(255)), 2, "0")), F.unhex(F.lpad(F.hex(F.shiftright("method", 8)), 2, "0")))
        old = F.coalesce(F.col("extra"), F.lit(b"")) if "extra" in rows.columns else F.lit(b"")
        out = out.withColumn("extra", F.when(file, F.concat(old, field)).otherwise(old)).withColumn("method", F.when(file, 99).otherwise(F.col("method"))).withColumn("crc", F.when(file, 0).otherwise(F.col("crc")))
    return out
