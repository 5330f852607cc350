"""Archives rewritten by the engine, read by Python's zipfile and by the engine again."""

import gzip
import hashlib
import io
import random
import tracemalloc
import zipfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from archlake.operators import verify
from archlake.sources import codecs, extract, rewrite, ziparchive, zipwriter

RNG = random.Random(7)
BLOB = RNG.randbytes(70000)
FILES = {"a/blob.bin": BLOB, "a/copy.bin": BLOB, "dir/": b"", "empty": b"", "t/text.txt": b"some words, some more words\r\n" * 400, "t/ünï.txt": b"x" * 50, "t/again.txt": b"x" * 50, "z/blob.bin": BLOB}


def make(path, files=FILES, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for n, d in files.items():
            i = zipfile.ZipInfo(n, (2026, 1, 2, 3, 4, 6))
            i.comment = n.encode("ascii", "ignore")
            i.external_attr = 0o100600 << 16
            z.writestr(i, d, method)
    return str(path)


def entries(spark, path):
    return ziparchive.read(spark, str(path), "entries", "FAILFAST", "*.zip").withColumn("archive", F.substring_index("archive", "/", -1))


def contents(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        return {i.filename: z.read(i) for i in z.infolist()}


def test_copied_keeps_everything(spark, tmp_path):
    make(tmp_path / "x.zip")
    zipwriter.write(rewrite.copied(entries(spark, tmp_path)), str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "x.zip") as a, zipfile.ZipFile(tmp_path / "out/x.zip") as b:
        what = lambda z: [(i.filename, i.date_time, i.comment, i.external_attr, i.CRC, i.compress_type, i.compress_size, z.read(i)) for i in z.infolist()]
        assert what(a) == what(b)


def test_optimized_is_never_larger(spark, tmp_path):
    make(tmp_path / "x.zip", method=zipfile.ZIP_STORED)
    rows = rewrite.optimized(entries(spark, tmp_path), "store,deflate,bzip2")
    zipwriter.write(rows, str(tmp_path / "out"))
    assert contents(tmp_path / "out/x.zip") == FILES
    with zipfile.ZipFile(tmp_path / "out/x.zip") as z:
        info = {i.filename: i for i in z.infolist()}
    assert info["a/blob.bin"].compress_type == 0 and info["t/text.txt"].compress_type in (8, 12) and all(i.compress_size <= len(FILES[n]) for n, i in info.items())
    only = {r.name: r.method for r in rewrite.optimized(entries(spark, tmp_path), "bzip2").collect()}
    assert only["a/blob.bin"] == 12 and only["dir/"] == 0


def test_damaged_members_stay(spark, tmp_path):
    make(tmp_path / "x.zip", {"t": b"words and words " * 200})
    data = bytearray((tmp_path / "x.zip").read_bytes())
    data[40] ^= 255
    (tmp_path / "x.zip").write_bytes(bytes(data))
    e = entries(spark, tmp_path)
    assert rewrite.optimized(e).first().payload == e.first().payload
    assert rewrite.deduplicated(e).first().method == 8


def test_references_and_back(spark, tmp_path):
    make(tmp_path / "x.zip")
    zipwriter.write(rewrite.deduplicated(entries(spark, tmp_path)), str(tmp_path / "out"))
    small = entries(spark, tmp_path / "out")
    assert {r.name: bytes(r.payload) for r in small.where("method = 92").collect()} == {n: hashlib.sha1(BLOB).digest() for n in ("a/copy.bin", "z/blob.bin")}
    tagged = {r.name: r.extras for r in small.where(F.exists("extras", lambda x: x["tag"] == 0x9903)).collect()}
    assert set(tagged) == {"a/blob.bin", "a/copy.bin", "z/blob.bin"} and len({bytes(x[-1].data[4:]) for x in tagged.values()}) == 1
    assert (tmp_path / "out/x.zip").stat().st_size < (tmp_path / "x.zip").stat().st_size - 2 * len(BLOB) + 500
    zipwriter.write(rewrite.copied(rewrite.expanded(small)), str(tmp_path / "back"))
    assert contents(tmp_path / "back/x.zip") == FILES
    lone = small.where("name <> 'a/blob.bin'")
    assert rewrite.expanded(lone).where("method = 92").count() == 2


def test_real_volumes(spark, tmp_path):
    make(tmp_path / "x.zip")
    n = zipwriter.write(rewrite.copied(entries(spark, tmp_path)), str(tmp_path / "out"), volume_size=1 << 16)
    assert n == len(list((tmp_path / "out").iterdir())) == 4
    whole = ziparchive.volumes(spark.read.format("binaryFile").load(str(tmp_path / "out")))
    got = ziparchive.tables_of(whole, "payloads", "FAILFAST")
    assert {r.name: r.c for r in got.select("name", codecs.decoded(F.col("method"), F.col("payload")).alias("c")).collect()} == FILES
    assert max(r.disk for r in ziparchive.tables_of(whole).collect()) > 0
    assert not verify.contents(got).take(1)
    with pytest.raises(ValueError):
        zipwriter.build_volumes([], volume_size=10)


def test_sums_after_data():
    data = b"late sums"
    row = {"name": "l", "method": 0, "payload": data, "crc": __import__("zlib").crc32(data), "usize": len(data), "dos_datetime": 0x5A210000, "flags": 8, "comment": ""}
    made = zipwriter.build([row, row | {"name": "m"}])
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.read("l") == z.read("m") == data
    assert made.count(b"PK\7\x08") == 2 and made[14:26] == bytes(12)
    assert [(r["usize"], r["crc"]) for r in ziparchive.salvaged(made)] == [(len(data), row["crc"])] * 2


def _members(n, size):
    data = RNG.randbytes(size)
    return [{"archive": "x.zip", "idx": i, "name": f"{i:03d}", "method": 0, "payload": data, "crc": __import__("zlib").crc32(data), "usize": size, "dos_datetime": 0x5A210000, "comment": ""} for i in range(n)]


@pytest.mark.parametrize("volume_size", [None, 1 << 16, 3 << 20])
def test_archives_are_not_held(volume_size):
    """An archive of 64 MB is written and read by a task that holds a few MB."""
    one = _members(1, 1 << 20)[0]
    parts = (pd.DataFrame([one | {"name": f"{i:03d}", "payload": bytes(bytearray(one["payload"]))}]) for i in range(64))
    tracemalloc.start()
    n = 0
    for frame in ziparchive.frames_of_pieces(zipwriter.pieces_of(parts, volume_size), "entries", "FAILFAST"):
        n += sum(__import__("zlib").crc32(p) == c for p, c in zip(frame["payload"], frame["crc"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 64 and most < 48 << 20


@pytest.mark.parametrize("volume_size", [None, 1 << 16])
def test_pieces_are_the_archive(spark, volume_size):
    rows = _members(20, 50000)
    df = spark.createDataFrame(pd.DataFrame(rows)).repartition(7)
    got = sorted((r.volume, r.at, bytes(r.content)) for r in zipwriter.pieces(df, volume_size).collect())
    volumes = [b"".join(c for v, _, c in got if v == k) for k in range(got[-1][0] + 1)]
    assert volumes == zipwriter.build_volumes(rows, b"", volume_size) and max(len(c) for *_, c in got) <= zipwriter.PIECE
    if not volume_size:
        with zipfile.ZipFile(io.BytesIO(volumes[0])) as z:
            assert z.testzip() is None and len(z.namelist()) == 20
    e = ziparchive.tables_of_pieces(zipwriter.pieces(df, volume_size), "entries", "FAILFAST").collect()
    assert [(r.idx, r.name, r.crc, bytes(r.payload)) for r in e] == [(r["idx"], r["name"], r["crc"], r["payload"]) for r in rows]
    # What isn't whole from its start on is an error of the caller's.
    cut = zipwriter.pieces(df, volume_size).where("volume > 0 or at > 0")
    with pytest.raises(Exception, match="out of order"):
        ziparchive.tables_of_pieces(cut, "members").collect()


def test_parts_and_notes(spark, tmp_path):
    make(tmp_path / "x.zip")
    assert zipwriter.write(rewrite.parted(entries(spark, tmp_path), 80000), str(tmp_path / "out")) == 3
    parts = [contents(p) for p in sorted((tmp_path / "out").iterdir())]
    assert {n: d for p in parts for n, d in p.items()} == FILES and sum(map(len, parts)) == len(FILES)
    assert all(p.stat().st_size <= 80000 for p in (tmp_path / "out").iterdir())
    edits = spark.createDataFrame([("x.zip", "empty", "none", None), ("x.zip", "t/text.txt", None, "read me")], "archive string, name string, new_name string, comment string")
    got = {r.name: r.comment for r in rewrite.noted(rewrite.copied(entries(spark, tmp_path / "x.zip")), edits).collect()}
    assert got["none"] == "empty" and got["t/text.txt"] == "read me" and "empty" not in got and len(got) == len(FILES)


def test_files_written(spark, tmp_path):
    make(tmp_path / "x.zip", FILES | {"../up.txt": b"up"})
    files = extract.files(ziparchive.read(spark, str(tmp_path), "payloads"))
    assert extract.write(files, str(tmp_path / "out")) == len(FILES)
    want = {n: d for n, d in FILES.items() if not n.endswith("/")} | {"__/up.txt": b"up"}
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == want
    assert (tmp_path / "out/dir").is_dir() and extract.write(files, str(tmp_path / "out")) == len(FILES)
    (tmp_path / "out/empty").write_bytes(b"mine")
    with pytest.raises(Exception, match="FileExistsError"):
        extract.write(files, str(tmp_path / "out"))
    flat = extract.files(ziparchive.read(spark, str(tmp_path), "payloads"), junk_paths=True, text=True).collect()
    got = {r.target: bytes(r.content) for r in flat if r.target}
    assert got["text.txt"] == FILES["t/text.txt"].replace(b"\r\n", b"\n") and got["blob.bin"] == BLOB


def test_first_streams_and_names(spark, tmp_path):
    make(tmp_path / "x.zip", {"t": b"first", "u": b"second"})
    zipped, packed = (tmp_path / "x.zip").read_bytes(), gzip.compress(b"first")
    rows = [("z", zipped), ("g", packed), ("cut", packed[:-9]), ("n", b"nothing"), ("e", b"")]
    got = {r.path: (r.kind, r.content and bytes(r.content), r.status) for r in extract.first_stream(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["z"] == ("zip", b"first", "ok") and got["g"] == ("gzip", b"first", "ok") and got["cut"][2] == "cut short" and got["n"][2] == got["e"][2] == "neither"
    (tmp_path / "list").write_text("a.txt\n\nb c.txt\r\n")
    assert [r.name for r in extract.names(spark, str(tmp_path / "list")).collect()] == ["a.txt", "b c.txt"]
    assert datetime(2026, 1, 2, 3, 4, 6) in {r.mtime for r in extract.files(ziparchive.read(spark, str(tmp_path), "payloads")).collect()}


def test_archives_are_read_once_for_references(spark, tmp_path):
    make(tmp_path / "x.zip")
    for how in (rewrite.deduplicated, rewrite.expanded):
        assert "MapInPandas" not in how(entries(spark, tmp_path))._jdf.queryExecution().toString()
