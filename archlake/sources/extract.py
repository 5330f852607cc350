"""Members to files, single streams and lists of names."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.functions import scalars as S
from archlake.sources import codecs, ziparchive


def files(payloads: DataFrame, junk_paths: bool = False, text: bool = False) -> DataFrame:
    """archive, idx, target, content, mtime of members that decode to their length and checksum.

    Names are made safe. With text, texts get line feeds alone. Of members with
    one target the last counts, as if each overwrote the one before.
    """
    raw = codecs.decoded(F.col("method"), F.col("payload"), F.col("flags"), F.col("usize"))
    name = S.junked(F.col("name")) if junk_paths else F.col("name")
    p = payloads.where(~F.col("encrypted")).withColumn("target", S.safe_path(name))
    last = p.groupBy("archive", "target").agg(F.max("idx").alias("idx"))
    d = p.join(last, ["archive", "target", "idx"], "left_semi").withColumn("content", raw)
    d = d.where((F.octet_length("content") == F.col("usize")) & ((F.col("aes_version") == 2) | (F.crc32("content") == F.col("crc"))))
    if text:
        d = d.withColumn("content", F.when(S.is_text(F.decode("content", "ISO-8859-1")), F.encode(S.to_lf(F.decode("content", "ISO-8859-1")), "ISO-8859-1")).otherwise(F.col("content")))
    return d.select("archive", "idx", "target", "content", S.dos_timestamp(F.col("dos_datetime")).alias("mtime"))


def write(files: DataFrame, folder: str, overwrite: bool = False) -> int:
    """Writes files under a folder that all machines share, each whole or not at all; their number. Repeated tasks write the same again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = os.path.realpath(folder)
        for part in parts:
            n = 0
            for target, content, mtime in zip(part["target"], part["content"], part["mtime"]):
                path = os.path.join(root, target)
                if os.path.commonpath([root, os.path.realpath(path)]) != root:
                    raise ValueError(f"{target} lies outside the folder")
                if not target or target.endswith("/"):
                    os.makedirs(path, exist_ok=True)
                    continue
                if os.path.exists(path) and not overwrite:
                    with open(path, "rb") as f:
                        if f.read() != bytes(content):
                            raise FileExistsError(path)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                beside = f"{path}.{os.getpid()}.part"
                with open(beside, "wb") as f:
                    f.write(content)
                if not pd.isna(mtime):
                    os.utime(beside, (mtime.timestamp(),) * 2)
                os.replace(beside, path)
                n += 1
            yield pd.DataFrame({"n": [n]})

    return files.select("target", "content", "mtime").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def first_stream(files: DataFrame) -> DataFrame:
    """Of each file (path, content; batch or streaming) its first stream, of a ZIP archive or gzip, read from the front: path, kind, content, status."""

    def one(data: bytes) -> tuple[str | None, bytes | None, str]:
        try:
            if data[:2] == b"\x1f\x8b":
                d = zlib.decompressobj(31)
                out = d.decompress(data)
                return "gzip", out, "ok" if d.eof else "cut short"
            if data[:4] != b"PK\3\4":
                return None, None, "neither"
            r = next(ziparchive.salvaged(data), None)
            if r is None or r["encrypted"]:
                return "zip", None, "encrypted" if r else "cut short"
            at = ziparchive.local_header(data, r["offset"])["data_offset"]
            raw = codecs.decode(r["method"], data[at : at + r["csize"]], r["flags"], r["usize"])
            good = raw is not None and len(raw) == r["usize"] and zlib.crc32(raw) == r["crc"]
            return "zip", raw if good else None, "ok" if good else "damaged"
        except (zlib.error, struct.error, ziparchive.Broken):
            return None, None, "damaged"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                yield pd.DataFrame([(path, *one(bytes(content)))], columns=["path", "kind", "content", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, content binary, status string")


def names(spark: SparkSession, path: str) -> DataFrame:
    """A list of names or patterns, one a line; empty lines don't count."""
    return spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("name")).where("name <> ''")
