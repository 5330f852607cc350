"""Archives from tables: a task writes the archives it holds, whole, then they are renamed into place.

Rows: archive (file name), idx, name, method, payload (packed), crc, usize,
dos_datetime and comment; if there, flags, extra and central_extra (fields as
bytes), host, version_made, internal_attr and external_attr. A task writes each archive beside its target and
moves it when all rows have succeeded; existing targets raise.
"""

from __future__ import annotations

import itertools
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlake.functions import scalars as S
from archlake.sources import codecs

#: Bytes of a piece; bytes of a catalog that stay in memory; bytes and rows that a Python worker gets at a time.
PIECE, CATALOG_HELD, BATCH_BYTES, BATCH_ROWS = 1 << 18, 8 << 20, 16 << 20, 2000


def packed(files: DataFrame, method: int = 8, suffixes_stored: str = "none", numbered: bool = True) -> DataFrame:
    """files: archive, name, content, mtime. Rows for write(), names in byte order; text that doesn't shrink is stored.

    Not numbered, rows have no idx and stay where they are: numbers by a window
    would hold each archive twice in one task. in_order() takes such rows.
    """
    from archlake.functions.glob import has_suffix

    wanted = F.when(has_suffix(F.col("name"), suffixes_stored), 0).otherwise(method)
    df = files.withColumn("tried", codecs.encoded(wanted, F.col("content")))
    smaller = F.octet_length("tried") < F.octet_length("content")
    # Chosen before the rows are dealt out by archive, so that each text moves in one form only.
    chosen = df.select(
        "archive", "name", F.when(smaller, wanted).otherwise(0).alias("method"), F.when(smaller, F.col("tried")).otherwise(F.col("content")).alias("payload"),
        F.crc32("content").alias("crc"), F.octet_length("content").cast("long").alias("usize"), S.dos_packed(F.col("mtime")).alias("dos_datetime"), F.lit("").alias("comment"),
    )
    if not numbered:
        return chosen
    place = F.row_number().over(Window.partitionBy("archive").orderBy(F.encode("name", "UTF-8"))).cast("long")
    return chosen.select("archive", place.alias("idx"), "name", "method", "payload", "crc", "usize", "dos_datetime", "comment")


class _Volumes:
    """Bytes in volumes of a size; records stay whole in one, data may run on into the next. What fills a piece or a volume can be taken away."""

    def __init__(self, size: int | None):
        if size is not None and size < 1 << 16:
            raise ValueError("volumes are of 64 KB at least")
        self.size, self.volume, self.start, self.held, self.full = size, 0, 0, bytearray(), []

    def _end(self, volume: bool) -> None:
        self.full.append((self.volume, self.start, bytes(self.held)))
        self.volume, self.start = (self.volume + 1, 0) if volume else (self.volume, self.start + len(self.held))
        self.held = bytearray()

    def here(self, record: int = 0) -> tuple[int, int]:
        """Volume and offset at which a record of this length would lie."""
        if self.size and self.start + len(self.held) + record > self.size:
            self._end(True)
        return self.volume, self.start + len(self.held)

    def put(self, data: bytes) -> None:
        while self.size and self.start + len(self.held) + len(data) > self.size:
            room = self.size - self.start - len(self.held)
            self.held += data[:room]
            self._end(True)
            data = data[room:]
        data = memoryview(data)
        while len(self.held) + len(data) >= PIECE:
            room = PIECE - len(self.held)
            self.held += data[:room]
            self._end(False)
            data = data[room:]
        self.held += data

    def taken(self, end: bool = False) -> list[tuple[int, int, bytes]]:
        """Volume, place in it and bytes of what is full, at the end of the rest too."""
        if end:
            self._end(False)
        out, self.full = self.full, []
        return out


def stream(rows: Iterable[dict], comment: bytes = b"", volume_size: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """An archive's bytes in order, in pieces: volume, place in it, bytes; wide records where numbers ask for them.

    A member whose flags have 8 gets its sums after its data, as a writer that can't go back does it.
    Held are one member, one piece, and of the catalog what a file beside doesn't take.
    """
    out, n, size, first = _Volumes(volume_size), 0, 0, 22
    if volume_size:
        out.put(b"PK\7\x08")
    with tempfile.SpooledTemporaryFile(CATALOG_HELD) as catalog:
        for r in rows:
            has = lambda k, other=0: other if r.get(k) is None or r[k] != r[k] else r[k]  # noqa: B023, E731
            name, data, own, late = r["name"].encode(), bytes(r["payload"] or b""), bytes(has("extra", b"")), int(has("flags")) & 8
            flags, need = (0x800 if not r["name"].isascii() else 0) | int(has("flags")), next((v for m, _, v in S.METHODS if m == r["method"]), 20)
            time, date = int(r["dos_datetime"]) & 0xFFFF, int(r["dos_datetime"]) >> 16
            usize, crc = int(r["usize"]), int(r["crc"])
            disk, at = out.here(30 + len(name) + 20 + len(own))
            wide = max(len(data), usize, at) >= 0xFFFFFFFF
            need = max(need, 45 if wide else 0)
            lextra = (struct.pack("<HHQQ", 1, 16, usize, len(data)) if wide else b"") + own
            sums = (0, 0, 0) if late and not wide else (crc, 0xFFFFFFFF, 0xFFFFFFFF) if wide else (crc, len(data), usize)
            out.put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", need, flags, r["method"], time, date, *sums, len(name), len(lextra)) + name + lextra)
            out.put(data)
            if late:
                tail = struct.pack("<4sIQQ" if wide else "<4sIII", b"PK\7\x08", crc, len(data), usize)
                out.here(len(tail))
                out.put(tail)
            extra = (struct.pack("<HHQQQ", 1, 24, usize, len(data), at) if wide else b"") + bytes(has("central_extra", own))
            csize, usize, offset = (0xFFFFFFFF,) * 3 if wide else (len(data), usize, at)
            note = (has("comment", "") or "").encode()
            made = int(has("host", 3)) << 8 | int(has("version_made", 63))
            record = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", made, need, flags, r["method"], time, date, crc, csize, usize, len(name), len(extra), len(note), disk, int(has("internal_attr")), int(has("external_attr", 0o100644 << 16)), offset) + name + extra + note
            catalog.write(struct.pack("<I", len(record)) + record)
            n, size, first = n + 1, size + len(record), first if n else len(record)
            yield from out.taken()
        cd_disk, start = out.here(first)
        at_disk, here = cd_disk, 0
        catalog.seek(0)
        while head := catalog.read(4):
            record = catalog.read(struct.unpack("<I", head)[0])
            disk = out.here(len(record))[0]
            at_disk, here = disk, here + 1 if disk == at_disk else 1
            out.put(record)
            yield from out.taken()
    last, at = out.here((98 if n >= 0xFFFF or start >= 0xFFFFFFFF else 22) + len(comment))
    here = here if last == at_disk else 0
    if n >= 0xFFFF or start >= 0xFFFFFFFF:
        out.put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 63, 45, last, cd_disk, here, n, size, start) + struct.pack("<4sIQI", b"PK\6\7", last, at, last + 1))
    out.put(struct.pack("<4sHHHHIIH", b"PK\5\6", last, cd_disk, min(here, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), len(comment)) + comment)
    yield from out.taken(True)


def build_volumes(rows: list[dict], comment: bytes = b"", volume_size: int | None = None) -> list[bytes]:
    """An archive's volumes, one if no size is given; as stream() writes them."""
    parts: list[bytearray] = []
    for volume, _, data in stream(rows, comment, volume_size):
        if volume == len(parts):
            parts.append(bytearray())
        parts[volume] += data
    return [bytes(p) for p in parts]


def build(rows: list[dict], comment: bytes = b"") -> bytes:
    return build_volumes(rows, comment)[0]


def archives(rows: DataFrame, volume_size: int | None = None) -> DataFrame:
    """archive and content: each archive's bytes, for any sink; with a size its volumes, `.z01`, `.z02`, ... and `.zip`. One task holds one archive, of less than 2 GB. archive_comment is taken where there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf.sort_values("idx").to_dict("records")
        name, note = some[0]["archive"], some[0].get("archive_comment")
        parts = build_volumes(some, bytes(note) if isinstance(note, (bytes, bytearray)) else b"", volume_size)
        base = name[:-4] if name.lower().endswith(".zip") else name
        names = [f"{base}.z{i:02d}" for i in range(1, len(parts))] + [name]
        return pd.DataFrame({"archive": names, "content": parts})

    return rows.groupBy("archive").applyInPandas(run, "archive string, content binary")


def pieces_of(parts: Iterable[pd.DataFrame], volume_size: int | None = None) -> Iterator[tuple[str, int, int, bytes]]:
    """archive, volume, at and content of the archives whose rows come in order."""
    records = (dict(zip(part.columns, r)) for part in parts for r in part.itertuples(index=False, name=None))
    for archive, some in itertools.groupby(records, lambda r: r["archive"]):
        first = next(some)
        note = first.get("archive_comment")
        for piece in stream(itertools.chain([first], some), bytes(note) if isinstance(note, (bytes, bytearray)) else b"", volume_size):
            yield archive, *piece


def in_order(rows: DataFrame, arranged: bool = False) -> DataFrame:
    """Each archive's rows in one partition, by idx or else in names' byte order; arranged: they are so already, as reading in pieces leaves them."""
    small_batches(rows.sparkSession)
    order = F.col("idx") if "idx" in rows.columns else F.encode("name", "UTF-8")
    return rows if arranged else rows.repartition("archive").sortWithinPartitions("archive", order)


def pieces(rows: DataFrame, volume_size: int | None = None, arranged: bool = False) -> DataFrame:
    """archive, volume, at and content: each archive's bytes in order, cut where a piece or a volume is full.

    One task goes over an archive and holds a piece of it, so an archive may be
    of any length. arranged: see in_order(). archive_comment is taken where there.
    """
    columns = ["archive", "volume", "at", "content"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces_of(parts, volume_size):
            yield pd.DataFrame([piece], columns=columns)

    return in_order(rows, arranged).mapInPandas(run, "archive string, volume int, at long, content binary")


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of few bytes, unless less is set: members and pieces are far longer than other rows."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def write(rows: DataFrame, folder: str, overwrite: bool = False, volume_size: int | None = None) -> int:
    """Writes archives under a folder that all machines share, each file at once or not at all; the number of files."""

    def run(parts):
        for part in parts:
            for name, content in zip(part["archive"], part["content"]):
                target = os.path.join(folder, os.path.basename(name))
                if os.path.exists(target) and not overwrite:
                    raise FileExistsError(target)
                os.makedirs(folder, exist_ok=True)
                beside = f"{target}.{os.getpid()}.part"
                with open(beside, "wb") as f:
                    f.write(content)
                os.replace(beside, target)
                yield pd.DataFrame({"archive": [name]})

    return archives(rows, volume_size).mapInPandas(run, "archive string").count()
