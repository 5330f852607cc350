"""Members' extended attributes as tables.

An owner's extra field names its manifest: in the field itself (inline), or
in a companion member whose name is made from the owner's id. Fields are read
in the JVM, manifests parsed and checked in Arrow batches, one a row. Broken
manifests give findings and no attributes, or raise in mode FAILFAST.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.functions import extras as X
from archlake.functions import scalars as S

from . import codecs

TAG = 0x5854
INLINE, COMPANION = 1, 2
ATTRIBUTES = "archive string, idx long, owner_id string, place int, type int, flags int, origin int, encoding int, namespace binary, name binary, tlvs array<struct<tag:int,flags:int,data:binary>>, value binary"
FINDINGS = "archive string, idx long, check string, severity int, detail string"

#: Fixed: the interfaces that a type of record from an origin may have.
INTERFACES = {(1, 1): 1, (1, 2): 2, (1, 3): 4, (1, 4): 5, (1, 5): 6, (1, 7): 8, (1, 8): 10, (2, 2): 3, (2, 6): 7, (3, 7): 9, (4, 4): 11, (5, 4): 12}
#: Fixed: bytes of a native value by its tag.
SIZES = {1: 2, 2: 4, 3: 1, 4: 4, 5: 4, 6: 12, 7: 12, 8: 12, 9: 12, 10: 4, 11: 4, 12: 4}
TIMES = (6, 7, 8, 9)


class Broken(ValueError):
    """The manifest isn't as its format asks."""


def _tlvs(data: bytes) -> list[dict]:
    out, i = [], 0
    while i < len(data):
        if i + 8 > len(data):
            raise Broken("native value is cut short")
        tag, flags, n = struct.unpack_from("<HHI", data, i)
        own = data[i + 8 : i + 8 + n]
        if len(own) < n:
            raise Broken("native value is cut short")
        if out and tag <= out[-1]["tag"]:
            raise Broken("native values are out of order")
        if tag in SIZES and n != SIZES[tag]:
            raise Broken(f"native value {tag} has {n} bytes")
        if tag in TIMES and struct.unpack_from("<I", own, 8)[0] > 999_999_999:
            raise Broken("more than a second of nanoseconds")
        out.append({"tag": tag, "flags": flags, "data": own})
        i += 8 + n
    return out


def _interface(r: dict) -> int:
    return next((struct.unpack("<H", t["data"])[0] for t in r["tlvs"] if t["tag"] == 1), 0)


def identity(r: dict) -> tuple:
    """What records are sorted by, and no two of them share."""
    return r["type"], r["origin"], r["encoding"], r["namespace"], r["name"], _interface(r)


def _checked(r: dict) -> dict:
    if r["type"] in (0, 65535):
        raise Broken(f"type {r['type']}")
    if r["encoding"] not in (0, 1, 2):
        raise Broken(f"encoding {r['encoding']}")
    if r["encoding"] == 2 and (len(r["name"]) % 2 or len(r["namespace"]) % 2):
        raise Broken("half a UTF-16 unit")
    if 1 <= r["type"] <= 5:
        if not r["name"]:
            raise Broken("no name")
        if 1 <= r["origin"] <= 9 and INTERFACES.get((r["type"], r["origin"])) != _interface(r):
            raise Broken("interface doesn't fit type and origin")
    return r


def parse(data: bytes, owner: bytes | None = None) -> list[dict]:
    """Records in order; raises Broken."""
    if len(data) < 36 or data[:8] != b"XTMD\1\0\0\0":
        raise Broken("no manifest of this version")
    if owner is not None and data[8:24] != owner:
        raise Broken("another owner's")
    count, total = struct.unpack_from("<IQ", data, 24)
    if total != len(data) - 36:
        raise Broken("length differs")
    out, i = [], 36
    for _ in range(count):
        if i + 28 > len(data):
            raise Broken("record is cut short")
        kind, flags, origin, encoding, a, b, c, d = struct.unpack_from("<HHHHIIIQ", data, i)
        cuts = [i := i + 28, i := i + a, i := i + b, i := i + c, i := i + d]
        if i > len(data):
            raise Broken("record is cut short")
        space, name, native, value = (data[x:y] for x, y in zip(cuts, cuts[1:]))
        r = _checked({"type": kind, "flags": flags, "origin": origin, "encoding": encoding, "namespace": space, "name": name, "tlvs": _tlvs(native), "value": value})
        if out and identity(out[-1]) >= identity(r):
            raise Broken("records are out of order")
        out.append(r)
    if i != len(data):
        raise Broken("bytes after the last record")
    return out


def encode(owner: bytes, records: list[dict]) -> bytes:
    """A manifest, records put in order."""
    body = bytearray()
    for r in sorted(records, key=identity):
        native = b"".join(struct.pack("<HHI", t["tag"], t["flags"], len(t["data"])) + bytes(t["data"]) for t in sorted(r["tlvs"], key=lambda t: t["tag"]))
        parts = [bytes(r["namespace"]), bytes(r["name"]), native, bytes(r["value"])]
        body += struct.pack("<HHHHIIIQ", r["type"], r["flags"], r["origin"], r["encoding"], *map(len, parts)) + b"".join(parts)
    return b"XTMD\1\0\0\0" + owner + struct.pack("<IQ", len(records), len(body)) + bytes(body)


def field(owner: bytes, manifest: bytes, companion: bool = False, encrypted: bool = False) -> bytes:
    """The catalog's field data; the local header has its first 40 bytes."""
    count = struct.unpack_from("<I", manifest, 24)[0]
    told = (0, 0, 0) if encrypted else (count, len(manifest), zlib.crc32(manifest))
    rest = b"" if encrypted else hashlib.sha256(manifest).digest() if companion else manifest
    return b"XTRO\1\0" + bytes([COMPANION if companion else INLINE, int(encrypted)]) + owner + struct.pack("<IQI", *told) + rest


def sealed(manifest: bytes) -> bytes:
    """What an encrypted companion holds."""
    return manifest + b"XTCS" + hashlib.sha256(manifest).digest()


def owner_fields(members: DataFrame) -> DataFrame:
    """archive, idx, owner_id, mode, hidden, count, length, crc, body: owners by their extra field, in the JVM."""
    d = F.col("data")
    rows = members.select("archive", "idx", X.lookup(F.col("extras"), TAG).alias("data")).where((F.length("data") >= 40) & (F.substring("data", 1, 6) == F.lit(b"XTRO\1\0")))
    return rows.select(
        "archive", "idx", F.lower(F.hex(F.substring(d, 9, 16))).alias("owner_id"), S.from_le(d, 6, 1).cast("int").alias("mode"), (S.from_le(d, 7, 1).cast("int") % 2 == 1).alias("hidden"),
        S.from_le(d, 24, 4).cast("long").alias("count"), S.from_le(d, 28, 8).try_cast("long").alias("length"), S.from_le(d, 36, 4).cast("long").alias("crc"),
        F.expr("substring(data, 41)").alias("body"),
    )


def owner_index(members: DataFrame) -> DataFrame:
    """archive, id, role, mode: owners by field and companions by name, for the check of pairs."""
    own = owner_fields(members).select("archive", F.col("owner_id").alias("id"), F.lit("owner").alias("role"), F.col("mode").cast("long").alias("mode"))
    told = members.select("archive", F.regexp_extract("name", r"^__XTRO_ZIP__/x/([0-9a-f]{32})[.]xtm$", 1).alias("id"))
    return own.unionByName(told.where("id <> ''").select("archive", "id", F.lit("companion").alias("role"), F.lit(None).cast("long").alias("mode")))


def manifests(members: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each owner's field and its manifest's bytes, null where the companion is missing; encrypted payloads must have been opened."""
    own = owner_fields(members)
    inline = own.where(F.col("mode") == INLINE).withColumn("manifest", F.col("body"))
    told = payloads.select("archive", F.regexp_extract("name", r"^__XTRO_ZIP__/x/([0-9a-f]{32})[.]xtm$", 1).alias("owner_id"), "method", "payload", "flags", "usize").where("owner_id <> ''")
    companions = told.select("archive", "owner_id", codecs.decoded(F.col("method"), F.col("payload"), F.col("flags"), F.col("usize")).alias("manifest"))
    return inline.unionByName(own.where(F.col("mode") != INLINE).join(companions, ["archive", "owner_id"], "left").select(*inline.columns))


def encoded(attributes: DataFrame) -> DataFrame:
    """Rows as attributes() gives them to manifests: archive, idx, owner_id, manifest and the catalog field that holds it. Owners' records meet in a task, never an archive's."""
    record = F.struct("type", "flags", "origin", "encoding", "namespace", "name", "tlvs", "value")
    owners = attributes.groupBy("archive", "idx", "owner_id").agg(F.collect_list(record).alias("records"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for owner, records in zip(part["owner_id"], part["records"]):
                plain = [{**r, "namespace": bytes(r["namespace"]), "name": bytes(r["name"]), "value": bytes(r["value"]), "tlvs": [{**t, "data": bytes(t["data"])} for t in r["tlvs"]]} for r in (dict(r) if isinstance(r, dict) else r.asDict(True) for r in records)]
                made.append(encode(bytes.fromhex(owner), plain))
            yield pd.DataFrame({"archive": part["archive"], "idx": part["idx"], "owner_id": part["owner_id"], "manifest": made, "field": [field(bytes.fromhex(o), m) for o, m in zip(part["owner_id"], made)]})

    return owners.mapInPandas(run, "archive string, idx long, owner_id string, manifest binary, field binary")


def _records(r) -> list[dict]:
    if r.mode not in (INLINE, COMPANION) or (r.mode == INLINE and r.hidden):
        raise Broken("no such mode")
    if r.owner_id == "0" * 32:
        raise Broken("no owner")
    if r.manifest is None:
        raise Broken("no companion")
    data = bytes(r.manifest)
    if r.hidden:
        if r.count or r.length or r.crc or len(r.body):
            raise Broken("tells what should be hidden")
        data, end = data[:-36], data[-36:]
        if end != b"XTCS" + hashlib.sha256(data).digest():
            raise Broken("digest differs")
        return parse(data, bytes.fromhex(r.owner_id))
    if r.length != len(data) or r.crc != zlib.crc32(data):
        raise Broken("length or checksum differs")
    if r.mode == COMPANION and bytes(r.body) != hashlib.sha256(data).digest():
        raise Broken("digest differs")
    out = parse(data, bytes.fromhex(r.owner_id))
    if len(out) != r.count:
        raise Broken("count differs")
    return out


def _parsed(found: bool, mode: str, batch: int = 1000):
    names = [c.split()[0] for c in (FINDINGS if found else "archive, idx, owner_id, place, type, flags, origin, encoding, namespace, name, tlvs, value").split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[dict] = []
            for r in part.itertuples():
                own = {"archive": r.archive, "idx": r.idx}
                try:
                    records = _records(r)
                    rows += [] if found else [{**own, "owner_id": r.owner_id, "place": i, **x} for i, x in enumerate(records)]
                except Broken as e:
                    if mode == "FAILFAST":
                        raise Broken(f"{r.archive}, member {r.idx}: {e}") from e
                    rows += [{**own, "check": "metadata", "severity": 2, "detail": str(e)}] if found else []
                while len(rows) >= batch:
                    yield pd.DataFrame([[x[c] for c in names] for x in rows[:batch]], columns=names, dtype=object)
                    rows = rows[batch:]
            if rows:
                yield pd.DataFrame([[x[c] for c in names] for x in rows], columns=names, dtype=object)

    return run


def attributes(manifests: DataFrame, mode: str = "LENIENT") -> DataFrame:
    """A row for each record of each whole manifest."""
    return manifests.mapInPandas(_parsed(False, mode), ATTRIBUTES)


def findings(manifests: DataFrame) -> DataFrame:
    """Broken manifests and why."""
    return manifests.mapInPandas(_parsed(True, "LENIENT"), FINDINGS)


def native(tlvs: Column, tag: int) -> Column:
    """A record's native value of a tag, or null."""
    return F.try_element_at(F.filter(tlvs, lambda t: t["tag"] == tag), F.lit(1))["data"]


def native_time(tlvs: Column, tag: int) -> Column:
    """Seconds and nanoseconds, both kept whole."""
    d = native(tlvs, tag)
    sec = S.from_le(d, 0, 8)
    return F.when(d.isNotNull(), F.struct(F.when(sec >= F.lit(str(2**63)).cast("decimal(20,0)"), sec - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(sec).cast("long").alias("sec"), S.from_le(d, 8, 4).cast("int").alias("nanos")))
