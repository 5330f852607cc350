"""Early methods and encryption: published vectors, other programs' streams, round trips, archives."""

import io
import random
import zipfile
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from archlake.operators import verify
from archlake.sources import codecs, crypto, legacy, ziparchive, zipwriter

RNG = random.Random(9)
WORDS = [bytes(RNG.choices(b"abcdefghij", k=RNG.randrange(2, 9))) for _ in range(200)]
TEXT = b" ".join(RNG.choices(WORDS, k=1500))
CASES = [b"", b"a", b"ab" * 500, RNG.randbytes(3000), bytes(70_000) + b"x", TEXT, b"\x90" * 300 + b"\x90\0" * 20]


@pytest.mark.parametrize("method", sorted(codecs.LEGACY))
def test_legacy_round_trip(method):
    for data in CASES:
        for flags in (0, 2, 4, 6) if method == 6 else (0,):
            assert codecs.decode(method, codecs.encode(method, data, flags), flags, len(data)) == data


def test_legacy_published_forms():
    assert legacy.dcl_explode(bytes.fromhex("00048224258f807f")) == b"AIAIAIAIAIAIA"
    for low in (4, 5, 6):
        assert legacy.dcl_explode(legacy.dcl_implode(TEXT, low, coded=True)) == TEXT
    for level, strategy in ((9, zlib.Z_DEFAULT_STRATEGY), (1, zlib.Z_FIXED), (0, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY)):
        c = zlib.compressobj(level, zlib.DEFLATED, -15, 9, strategy)
        assert legacy.inflate64(c.compress(TEXT) + c.flush()) == TEXT


def test_unshrink_partial_clear():
    p = legacy._Packer()
    for code in (97, 98, 257, 256, 2, 99, 100, 258):
        p.put(code, 9)
    assert legacy.unshrink(p.done()) == b"ababcdcd"


def test_unreduce_followers():
    p = legacy._Packer()
    for i in range(255, -1, -1):
        own = {0: b"x", ord("x"): b"yz", ord("y"): b"x"}.get(i, b"")
        p.put(len(own), 6)
        for b in own:
            p.put(b, 8)
    for value, bits in ((0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (1, 1), (ord("q"), 8)):  # x, y, x, z by followers; z has none, q is plain
        p.put(value, bits)
    assert legacy.unreduce(p.done(), 1, 5) == b"xyxzq"


@pytest.mark.parametrize("method", [*sorted(codecs.LEGACY), *sorted(codecs.CODECS)])
def test_damage_gives_null_or_bytes(method):
    packed = codecs.encode(method, TEXT)
    for cut in (0, 1, 5, len(packed) // 2):
        assert codecs.decode(method, packed[:cut], 0, len(TEXT)) != TEXT
    for _ in range(10):
        broken = bytearray(packed)
        broken[RNG.randrange(len(broken))] ^= 1 << RNG.randrange(8)
        codecs.decode(method, bytes(broken), 0, len(TEXT))


@pytest.mark.parametrize(
    ("key", "sealed"),
    [  # FIPS-197, appendix C
        ("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"),
        ("000102030405060708090a0b0c0d0e0f1011121314151617", "dda97ca4864cdfe06eaf70a0ec0d7191"),
        ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089"),
    ],
)
def test_aes_vectors(key, sealed):
    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)
    assert crypto.aes_blocks(bytes.fromhex(key), plain[None])[0].tobytes().hex() == sealed


def test_ciphers():
    for data in (b"", b"x", TEXT):
        for strength in (1, 2, 3):
            sealed = crypto.aes_encrypt(data, b"pw", strength)
            assert crypto.aes_decrypt(sealed, b"pw", strength) == data
            with pytest.raises(crypto.Refused):
                crypto.aes_decrypt(sealed, b"other", strength)
            with pytest.raises(crypto.Refused):
                crypto.aes_decrypt(sealed[:-1] + bytes([sealed[-1] ^ 1]), b"pw", strength)
        assert crypto.old_decrypt(crypto.old_encrypt(data, b"pw", 7), b"pw", 7) == data


@pytest.mark.parametrize("strength", [0, 1, 3])
def test_encrypted_archives(spark, tmp_path, strength):
    rows = [("e.zip", n, d, datetime(2026, 1, 2)) for n, d in (("t.txt", TEXT), ("r.bin", RNG.randbytes(500)), ("empty", b""), ("d/", b""))]
    files = spark.createDataFrame(rows, "archive string, name string, content binary, mtime timestamp")
    zipwriter.write(crypto.encrypted(zipwriter.packed(files), b"secret", strength), str(tmp_path))
    p = ziparchive.read(spark, str(tmp_path), "payloads")
    assert {r.detail for r in verify.contents(p).collect()} == {"encrypted"}
    assert not verify.contents(p, b"secret").take(1)
    assert verify.contents(p, b"wrong").where("detail = 'encrypted'").count() >= 2  # the old cipher's check is one byte
    opened = crypto.decrypted(p, b"secret").select("name", codecs.decoded(F.col("method"), F.col("payload")).alias("raw"))
    assert {r.name: bytes(r.raw) for r in opened.collect()} == {n: d for _, n, d, _ in rows}
    if not strength:  # read by another program
        with zipfile.ZipFile(tmp_path / "e.zip") as z:
            assert z.read("t.txt", b"secret") == TEXT


def test_legacy_in_archives(spark, tmp_path):
    data = [(f"m{m}-{f}", m, f) for m in codecs.LEGACY for f in ((0, 2, 4, 6) if m == 6 else (0,))]
    rows = [{"name": n, "method": m, "flags": f, "payload": codecs.encode(m, TEXT, f), "crc": zlib.crc32(TEXT), "usize": len(TEXT), "dos_datetime": 0x21 << 16} for n, m, f in data]
    (tmp_path / "l.zip").write_bytes(zipwriter.build(rows))
    assert [i.filename for i in zipfile.ZipFile(io.BytesIO((tmp_path / "l.zip").read_bytes())).infolist()] == [n for n, *_ in data]
    p = ziparchive.read(spark, str(tmp_path), "payloads")
    assert p.count() == len(data)
    assert not verify.contents(p).take(1)


def test_sealed_together():
    """Many texts at once, each under its own salt, as each by itself."""
    data = [RNG.randbytes(n) for n in (0, 1, 15, 16, 17, 5000, 70000, 0)]
    for strength in (1, 2, 3):
        salts = [RNG.randbytes(4 + 4 * strength) for _ in data]
        sealed = crypto.aes_encrypt_all(data, b"pw", strength, salts)
        assert sealed == [crypto.aes_encrypt(d, b"pw", strength, s) for d, s in zip(data, salts)]
        assert [crypto.aes_decrypt(s, b"pw", strength) for s in sealed] == data
    assert len(set(crypto.aes_encrypt_all([b"same"] * 50, b"pw"))) == 50


def test_keys_are_made_in_more_tasks_than_archives(spark):
    """One archive's members are opened by several tasks."""
    from archlake.plans import registry

    key = "spark.sql.adaptive.coalescePartitions.enabled"  # so few bytes would be put together
    spark.conf.set(key, "false")
    seen = registry._sealed(spark, "/root/testdata/sf0.001").withColumn("p", F.spark_partition_id()).groupBy("archive").agg(F.countDistinct("p").alias("n")).collect()
    spark.conf.unset(key)
    assert seen and all(r.n > 1 for r in seen)
