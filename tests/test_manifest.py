"""Attribute manifests: round trips, each rule's breach, and archives with owners and companions."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from archlake.operators import verify
from archlake.sources import crypto, manifest, ziparchive, zipwriter

ID = bytes(range(16))


def tlv(tag, data, flags=0):
    return {"tag": tag, "flags": flags, "data": data}


def record(name, value=b"v", type=1, origin=1, interface=1, encoding=0, namespace=b"user", more=()):
    return {"type": type, "flags": 0, "origin": origin, "encoding": encoding, "namespace": namespace, "name": name, "tlvs": [tlv(1, struct.pack("<H", interface)), *more], "value": value}


RECORDS = [record(b"b", b""), record(b"a", b"\0\1"), record(b"stream", type=3, origin=7, interface=9), record(b"a", more=[tlv(7, struct.pack("<qI", -5, 999_999_999))], origin=4, interface=5)]


def test_round_trip():
    m = manifest.encode(ID, RECORDS)
    got = manifest.parse(m, ID)
    assert [r["name"] for r in got] == [b"a", b"b", b"a", b"stream"]
    assert sorted(map(repr, got)) == sorted(map(repr, RECORDS))
    assert manifest.encode(ID, got) == m and manifest.parse(manifest.encode(ID, [])) == []


@pytest.mark.parametrize(
    ("why", "records"),
    [
        ("out of order", [record(b"a"), record(b"a", b"other")]),
        ("no name", [record(b"")]),
        ("type 0", [record(b"a", type=0)]),
        ("encoding 3", [record(b"a", encoding=3)]),
        ("half a UTF-16", [record(b"abc", encoding=2)]),
        ("interface", [record(b"a", interface=2)]),
        ("native value 2", [record(b"a", more=[tlv(2, b"123")])]),
        ("native values are out", [record(b"a", more=[tlv(2, b"1234"), tlv(2, b"1234")])]),
        ("nanoseconds", [record(b"a", more=[tlv(6, struct.pack("<qI", 1, 10**9))])]),
    ],
)
def test_breaches(why, records):
    with pytest.raises(manifest.Broken, match=why):
        manifest.parse(manifest.encode(ID, records))


def test_damage():
    m = manifest.encode(ID, RECORDS)
    for cut in range(0, len(m), 7):
        with pytest.raises(manifest.Broken):
            manifest.parse(m[:cut])
    for bad in (m + b"x", b"XTMD\2" + m[5:], m[:24] + struct.pack("<I", 9) + m[28:]):
        with pytest.raises(manifest.Broken):
            manifest.parse(bad)
    with pytest.raises(manifest.Broken, match="another owner"):
        manifest.parse(m, bytes(16))


def row(name, data=b"", extra=b""):
    return {"name": name, "method": 0, "payload": data, "crc": zlib.crc32(data), "usize": len(data), "dos_datetime": 0x21 << 16, "extra": struct.pack("<HH", manifest.TAG, len(extra)) + extra if extra else b""}


def test_archives(spark, tmp_path):
    ids = [hashlib.md5(str(i).encode()).digest() for i in range(6)]
    m = [manifest.encode(i, RECORDS[: n % 5]) for n, i in enumerate(ids)]
    name = lambda i: f"__XTRO_ZIP__/x/{i.hex()}.xtm"
    rows = [
        row("inline", b"1", manifest.field(ids[1], m[1])),
        row("beside", b"2", manifest.field(ids[2], m[2], companion=True)), row(name(ids[2]), m[2]),
        row("broken", b"3", manifest.field(ids[3], m[3], companion=True)), row(name(ids[3]), m[3][:-1] + b"?"),
        row("alone", b"4", manifest.field(ids[4], m[4], companion=True)), row(name(ids[5]), m[5]),
        row("plain", b"5"), row("other", b"6", b"not this field's form"),
    ]
    (tmp_path / "x.zip").write_bytes(zipwriter.build(rows))
    members, payloads = ziparchive.read(spark, str(tmp_path)), ziparchive.read(spark, str(tmp_path), "payloads")
    all_of = manifest.manifests(members, payloads)
    got = manifest.attributes(all_of)
    assert [(r.idx, r.owner_id, bytes(r.name)) for r in got.orderBy("idx", "place").collect()] == [(0, ids[1].hex(), b"b"), (1, ids[2].hex(), b"a"), (1, ids[2].hex(), b"b")]
    assert {(r.idx, r.detail) for r in manifest.findings(all_of).collect()} == {(3, "length or checksum differs"), (5, "no companion")}
    assert {r.id for r in verify.owners(manifest.owner_index(members)).collect()} == {ids[4].hex(), ids[5].hex()}
    with pytest.raises(Exception, match="no companion|checksum differs"):
        manifest.attributes(all_of, "FAILFAST").collect()
    assert manifest.attributes(all_of.where("false")).count() == 0


def test_hidden_companion_and_times(spark, tmp_path):
    m = manifest.encode(ID, RECORDS)
    rows = spark.createDataFrame([(n, i, "x.zip", 0, d, zlib.crc32(d), len(d), 0x21 << 16, e) for i, (n, d, e) in enumerate([("own", b"1", manifest.field(ID, m, True, True)), (f"__XTRO_ZIP__/x/{ID.hex()}.xtm", manifest.sealed(m), b"")])], "name string, idx long, archive string, method int, payload binary, crc long, usize long, dos_datetime long, extra binary")
    rows = rows.withColumn("extra", F.when(F.length("extra") > 0, F.concat(F.lit(struct.pack("<HH", manifest.TAG, 40)), "extra")).otherwise(F.col("extra")))
    zipwriter.write(crypto.encrypted(rows, b"pw"), str(tmp_path))
    members, payloads = ziparchive.read(spark, str(tmp_path)), ziparchive.read(spark, str(tmp_path), "payloads")
    got = manifest.attributes(manifest.manifests(members, crypto.decrypted(payloads, b"pw"))).select("origin", manifest.native_time(F.col("tlvs"), 7).alias("t")).collect()
    assert len(got) == 4 and [tuple(r.t) for r in got if r.t] == [(-5, 999_999_999)]
    assert [r.detail for r in manifest.findings(manifest.manifests(members, crypto.decrypted(payloads, b"no"))).collect()] == ["no companion"]
