"""ZIP archives as tables.

Files are listed and read by Spark's own binary reader, so any file system
that Spark knows will do, and a task parses whole archives: catalogs are read
from their trailer, in mode SALVAGE from local headers alone. Members' bytes
are a table of their own, read only by those who ask for it.

Modes: LENIENT reports a broken archive in its status, FAILFAST raises,
SALVAGE finds what it can.
"""

from __future__ import annotations

import contextlib
import itertools
import mmap
import re
import struct
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVES = "archive string, length long, entry_count long, cd_offset long, cd_size long, eocd_offset long, disk int, cd_disk int, is_zip64 boolean, comment binary, sfx_prefix long, status string, error string"
MEMBERS = (
    "archive string, idx long, name string, raw_name binary, method int, real_method int, flags int, version_made int, host int, version_needed int, dos_datetime long, crc long, csize long, usize long, disk int, "
    "internal_attr int, external_attr long, offset long, comment string, extras array<struct<tag:int,data:binary>>, is_dir boolean, is_text boolean, encrypted boolean, aes_version int, aes_strength int"
)
LOCAL = "archive string, idx long, offset long, data_offset long, method int, flags int, dos_datetime long, crc long, csize long, usize long, raw_name binary, extras array<struct<tag:int,data:binary>>"
PAYLOADS = "archive string, idx long, name string, method int, flags int, dos_datetime long, crc long, usize long, encrypted boolean, aes_version int, aes_strength int, payload binary"
ENTRIES = MEMBERS + ", local_extras array<struct<tag:int,data:binary>>, payload binary"

_EOCD, _LOC64, _END64, _CEN, _LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
_MAX = 2**63 - 1
#: Bytes of payloads that a task gives on at a time.
FRAME = 8 << 20


class Broken(ValueError):
    """The archive can't be read as asked."""


def parse_extras(data: bytes) -> list[dict]:
    """Fields in order; what doesn't fit is left out."""
    out, i = [], 0
    while i + 4 <= len(data):
        tag, n = struct.unpack_from("<HH", data, i)
        if i + 4 + n > len(data):
            break
        out.append({"tag": tag, "data": data[i + 4 : i + 4 + n]})
        i += 4 + n
    return out


def _find(extras: list[dict], tag: int) -> bytes | None:
    return next((x["data"] for x in extras if x["tag"] == tag), None)


def decode_name(raw: bytes, flags: int, extras: list[dict]) -> str:
    """UTF-8 by flag, else the Unicode field if it is of this name, else the old charset."""
    if flags & 0x800:
        return raw.decode("utf-8", "replace")
    u = _find(extras, 0x7075)
    if u and len(u) > 5 and u[0] == 1 and struct.unpack_from("<I", u, 1)[0] == zlib.crc32(raw):
        return u[5:].decode("utf-8", "replace")
    return raw.decode("cp437")


def trailer(data: bytes, starts: list[int] | None = None) -> dict:
    """The end record, the wide one where the locator names it; raises Broken. starts: where each volume begins, if there are several."""
    at = data.rfind(_EOCD)
    while at >= 0:
        if at + 22 <= len(data) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] <= len(data):
            break
        at = data.rfind(_EOCD, 0, at)
    if at < 0:
        raise Broken("no end record")
    disk, cd_disk, _, count, size, offset, n = struct.unpack_from("<HHHHIIH", data, at + 4)
    t = {"disk": disk, "cd_disk": cd_disk, "entry_count": count, "cd_size": size, "cd_offset": offset, "eocd_offset": at, "is_zip64": False, "comment": data[at + 22 : at + 22 + n]}
    end = at
    if at >= 20 and data[at - 20 : at - 16] == _LOC64:
        wide = struct.unpack_from("<Q", data, at - 12)[0] + _start(starts, struct.unpack_from("<I", data, at - 16)[0])
        if wide > len(data) or data[wide : wide + 4] != _END64:
            wide = data.rfind(_END64, 0, at - 20)
        if wide < 0:
            raise Broken("no wide end record")
        disk, cd_disk, _, count, size, offset = struct.unpack_from("<IIQQQQ", data, wide + 16)
        t |= {"disk": disk, "cd_disk": cd_disk, "entry_count": count, "cd_size": size, "cd_offset": offset, "is_zip64": True}
        end = wide
    if max(t["entry_count"], t["cd_size"], t["cd_offset"]) > _MAX:
        raise Broken("a number beyond 2^63")
    t["starts"] = starts
    t["sfx_prefix"] = 0 if starts else end - t["cd_size"] - t["cd_offset"]
    if t["sfx_prefix"] < 0:
        raise Broken("catalog beyond the file")
    return t


def _start(starts: list[int] | None, disk: int) -> int:
    if not starts:
        return 0
    if disk >= len(starts):
        raise Broken(f"no volume {disk}")
    return starts[disk]


def _wide(extras: list[dict], **values: int) -> dict:
    """32-bit sentinels replaced by what the wide field has, in its order."""
    data, i = _find(extras, 1) or b"", 0
    for k, v in values.items():
        if v == 0xFFFFFFFF:
            if i + 8 > len(data):
                raise Broken(f"wide field is too short for {k}")
            values[k] = struct.unpack_from("<Q", data, i)[0]
            i += 8
            if values[k] > _MAX:
                raise Broken(f"{k} beyond 2^63")
    return values


def members(data: bytes, t: dict) -> Iterator[dict]:
    """Rows of the catalog, until its size ends; a count modulo 65536 doesn't matter."""
    i = t["cd_offset"] + t["sfx_prefix"] + _start(t["starts"], t["cd_disk"])
    end, idx = i + t["cd_size"], 0
    while i < end:
        if data[i : i + 4] != _CEN or i + 46 > end:
            raise Broken(f"no catalog record at {i}")
        made, need, flags, method, time, date, crc, csize, usize, nlen, elen, clen, disk, internal, external, offset = struct.unpack_from("<HHHHHHIIIHHHHHII", data, i + 4)
        raw, extra = data[i + 46 : i + 46 + nlen], data[i + 46 + nlen : i + 46 + nlen + elen]
        extras = parse_extras(extra)
        w = _wide(extras, usize=usize, csize=csize, offset=offset)
        aes = _find(extras, 0x9901)
        valid = bool(aes) and len(aes) >= 7 and method == 99
        name = decode_name(raw, flags, extras)
        comment = data[i + 46 + nlen + elen : i + 46 + nlen + elen + clen]
        yield {
            "idx": idx, "name": name, "raw_name": raw, "method": method, "real_method": struct.unpack_from("<H", aes, 5)[0] if valid else method, "flags": flags, "version_made": made & 255, "host": made >> 8,
            "version_needed": need, "dos_datetime": date << 16 | time, "crc": crc, "csize": w["csize"], "usize": w["usize"], "disk": disk, "internal_attr": internal, "external_attr": external,
            "offset": w["offset"] + t["sfx_prefix"] + _start(t["starts"], disk), "comment": comment.decode("utf-8" if flags & 0x800 else "cp437", "replace"), "extras": extras, "is_dir": name.endswith("/"), "is_text": bool(internal & 1),
            "encrypted": bool(flags & 1), "aes_version": struct.unpack_from("<H", aes, 0)[0] if valid else 0, "aes_strength": aes[4] if valid else 0,
        }
        i += 46 + nlen + elen + clen
        idx += 1


def local_header(data: bytes, at: int) -> dict:
    if data[at : at + 4] != _LOCAL or at + 30 > len(data):
        raise Broken(f"no local header at {at}")
    _, flags, method, time, date, crc, csize, usize, nlen, elen = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
    extras = parse_extras(data[at + 30 + nlen : at + 30 + nlen + elen])
    w = _wide(extras, usize=usize, csize=csize)
    return {"offset": at, "data_offset": at + 30 + nlen + elen, "method": method, "flags": flags, "dos_datetime": date << 16 | time, "crc": crc, "csize": w["csize"], "usize": w["usize"], "raw_name": data[at + 30 : at + 30 + nlen], "extras": extras}


def salvaged(data: bytes) -> Iterator[dict]:
    """Members by local headers from the start on; where a size is unknown the next header ends the data."""
    at, idx = data.find(_LOCAL), 0
    while at >= 0:
        nxt = at + 4
        try:
            h = local_header(data, at)
            end = h["data_offset"] + h["csize"]
            if h["flags"] & 8 and not h["csize"]:
                marks = [m for m in (data.find(s, h["data_offset"]) for s in (b"PK\7\x08", _LOCAL, _CEN)) if m >= 0]
                end = min(marks, default=len(data))
                h["csize"] = end - h["data_offset"]
                if data[end : end + 4] == b"PK\7\x08" and end + 16 <= len(data):
                    h["crc"], _, h["usize"] = struct.unpack_from("<III", data, end + 4)
            if end <= len(data):
                yield {
                    "idx": idx, "name": decode_name(h["raw_name"], h["flags"], h["extras"]), "raw_name": h["raw_name"], "method": h["method"], "real_method": h["method"], "flags": h["flags"], "version_made": 0, "host": 0,
                    "version_needed": 0, "dos_datetime": h["dos_datetime"], "crc": h["crc"], "csize": h["csize"], "usize": h["usize"], "disk": 0, "internal_attr": 0, "external_attr": 0, "offset": at, "comment": "",
                    "extras": h["extras"], "is_dir": h["raw_name"].endswith(b"/"), "is_text": False, "encrypted": bool(h["flags"] & 1), "aes_version": 0, "aes_strength": 0,
                }
                idx += 1
                nxt = end
        except Broken:
            pass
        at = data.find(_LOCAL, nxt)


def _row(archive: str, data: bytes, table: str, r: dict) -> dict:
    """A member's row of one of the tables of members."""
    if table == "members":
        return {"archive": archive, **r}
    h = local_header(data, r["offset"])
    if table == "local_headers":
        return {"archive": archive, "idx": r["idx"], **h}
    payload = data[h["data_offset"] : h["data_offset"] + r["csize"]]
    if table == "entries":
        return {"archive": archive, **r, "local_extras": h["extras"], "payload": payload}
    own = {c: r[c] for c in ("idx", "name", "flags", "dos_datetime", "crc", "usize", "encrypted", "aes_version", "aes_strength")}
    return {"archive": archive, **own, "method": r["real_method"], "payload": payload}


def _rows(archive: str, data: bytes, table: str, mode: str, starts: list[int] | None = None) -> Iterator[dict]:
    """Rows one at a time. Where a broken archive is not to raise, it is gone over before the first row, as it has none."""
    try:
        t = trailer(data, starts) if mode != "SALVAGE" else None
        if table == "archives":
            yield {"archive": archive, "length": len(data), "status": "ok", "error": None, **(t or {})}
            return
        each = lambda: members(data, t) if t else salvaged(data)
        if mode != "FAILFAST":
            for r in each():
                if table != "members":
                    local_header(data, r["offset"])
        for r in each():
            yield _row(archive, data, table, r)
    except (Broken, struct.error) as e:
        if mode == "FAILFAST":
            raise Broken(f"{archive}: {e}") from e
        if table == "archives":
            yield {"archive": archive, "length": len(data), "status": "error", "error": str(e)}


SCHEMAS = {"archives": ARCHIVES, "members": MEMBERS, "local_headers": LOCAL, "payloads": PAYLOADS, "entries": ENTRIES}


def _frames(rows: Iterator[dict], names: list[str], batch: int) -> Iterator[pd.DataFrame]:
    """Frames of so many rows, or of fewer with long payloads."""
    some, held = [], 0
    for r in rows:
        some.append([r.get(c) for c in names])
        held += len(r.get("payload") or b"")
        if len(some) == batch or held > FRAME:
            yield pd.DataFrame(some, columns=names, dtype=object)
            some, held = [], 0
    if some:
        yield pd.DataFrame(some, columns=names, dtype=object)


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMAS[table])]


def tables_of(files: DataFrame, table: str = "members", mode: str = "LENIENT", batch: int = 5000) -> DataFrame:
    """files: path and content, as the binary reader gives them, batch or streaming; starts of volumes() if there. One row per archive, member or header."""
    names = _names(table)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content, *starts in part.itertuples(index=False, name=None):
                yield from _frames(_rows(path, bytes(content), table, mode, [int(x) for x in starts[0]] if starts and starts[0] is not None else None), names, batch)

    return files.select("path", "content", *(["starts"] if "starts" in files.columns else [])).mapInPandas(run, SCHEMAS[table])


def frames_of_pieces(pieces: Iterable[tuple[str, int, int, bytes]], table: str = "members", mode: str = "LENIENT", batch: int = 2000) -> Iterator[pd.DataFrame]:
    """Rows of archives in pieces (archive, volume, at, content) that come in order. An archive is put together in a file, mapped and not held in memory, which goes when it has been read."""
    for archive, some in itertools.groupby(pieces, lambda r: r[0]):
        with tempfile.TemporaryFile() as f:
            starts, length = [], 0
            for _, volume, at, content in some:
                if volume == len(starts) and not at:
                    starts.append(length)
                if volume != len(starts) - 1 or at != length - starts[-1]:
                    raise Broken(f"{archive}: pieces out of order")
                length += f.write(content)
            f.flush()
            with mmap.mmap(f.fileno(), length, access=mmap.ACCESS_READ) if length else contextlib.nullcontext(b"") as data:
                yield from _frames(_rows(archive, data, table, mode, starts if len(starts) > 1 else None), _names(table), batch)


def tables_of_pieces(pieces: DataFrame, table: str = "members", mode: str = "LENIENT") -> DataFrame:
    """tables_of() from a writer's pieces, each archive's in order in one partition, as pieces() gives them; its rows come in order too."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for part in parts for r in part[["archive", "volume", "at", "content"]].itertuples(index=False, name=None))
        yield from frames_of_pieces(rows, table, mode)

    return pieces.mapInPandas(run, SCHEMAS[table])


def read(spark: SparkSession, path: str, table: str = "members", mode: str = "LENIENT", glob: str = "*.zip", recursive: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return tables_of(files, table, mode)


def filesystem(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files under a path: path, mtime, usize and, if asked for, content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    cols = [F.col("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("usize")]
    return df.select(*cols, *([F.col("content")] if content else []))


def volumes(files: DataFrame) -> DataFrame:
    """Split archives put together: `.z01`, `.z02`, ... then `.zip`. files: path, content. starts tells where each volume begins."""
    base = F.regexp_replace("path", r"(?i)\.z(?:ip|\d+)$", "")
    part = F.regexp_extract("path", r"(?i)\.z(\d+)$", 1)
    order = F.when(part == "", F.lit(1 << 30)).otherwise(part.try_cast("int"))
    whole = files.groupBy(F.concat(base, F.lit(".zip")).alias("path")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "content"))).alias("v"))
    content = F.aggregate("v", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"]))
    starts = F.aggregate("v", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.octet_length(x["content"])))
    return whole.select("path", content.alias("content"), F.slice(starts, 1, F.size("v")).alias("starts"))
