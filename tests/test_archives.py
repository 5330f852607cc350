"""Archives built by Python's zipfile, read by the engine, and the other way round."""

import io
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from archlake.functions import glob
from archlake.functions import scalars as S
from archlake.operators import listing, optimize, split, sync, verify
from archlake.sources import ziparchive, zipwriter

RNG = random.Random(475)
FILES = {"a/one.txt": b"hello hello hello " * 50, "b/two.bin": RNG.randbytes(9000), "c/": b"", "d/ünï.txt": b"x", "empty": b""}


def make(path, comment=b"", method=zipfile.ZIP_DEFLATED, prefix=b""):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", method) as z:
        for n, d in FILES.items():
            z.writestr(zipfile.ZipInfo(n, (2026, 10, 8, 4, 8, 2)), d, method)
        z.comment = comment
    path.write_bytes(prefix + buf.getvalue())


def test_catalog_and_contents(spark, tmp_path):
    make(tmp_path / "x.zip", b"note")
    make(tmp_path / "sub.zip", method=zipfile.ZIP_BZIP2, prefix=b"#!/bin/sh\n")
    (tmp_path / "bad.zip").write_bytes(b"PK\3\4 nothing")
    got = ziparchive.read(spark, str(tmp_path)).collect()
    assert {(r.archive.rsplit("/", 1)[1], r.name, r.usize) for r in got} == {(z, n, len(d)) for z in ("x.zip", "sub.zip") for n, d in FILES.items()}
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        want = {i.filename: (i.CRC, i.compress_size, i.header_offset, i.compress_type) for i in z.infolist()}
    assert {r.name: (r.crc, r.csize, r.offset, r.method) for r in got if r.archive.endswith("x.zip")} == want
    status = {r.archive.rsplit("/", 1)[1]: (r.status, r.entry_count) for r in ziparchive.read(spark, str(tmp_path), "archives").collect()}
    assert status == {"x.zip": ("ok", 5), "sub.zip": ("ok", 5), "bad.zip": ("error", None)}
    with pytest.raises(Exception, match="no end record"):
        ziparchive.read(spark, str(tmp_path), mode="FAILFAST").collect()
    assert not verify.contents(ziparchive.read(spark, str(tmp_path), "payloads")).take(1)
    m, l = ziparchive.read(spark, str(tmp_path)), ziparchive.read(spark, str(tmp_path), "local_headers")
    assert not verify.headers(m, l).take(1)


def test_strict_and_columns(spark, tmp_path):
    make(tmp_path / "x.zip")
    m, l = ziparchive.read(spark, str(tmp_path)), ziparchive.read(spark, str(tmp_path), "local_headers")
    assert not verify.strict(m, l, ()).take(1)
    moved = m.withColumn("offset", F.when(F.col("idx") == 2, F.col("offset") - 1).otherwise(F.col("offset")))
    assert [(r.idx, r.check, r.detail) for r in verify.strict(moved, l, ()).collect()] == [(2, "overlap", "1")]
    line = listing.columns(m).where("name = 'a/one.txt'").first()
    assert (line["mode"], line.version, line.host, line.kind, line.fields, line.code) == ("?rw-------", "2.0", "unx", "b", "-", "defN")
    mode = lambda x: spark.range(1).select(listing.unix_mode(F.lit(x))).first()[0]
    assert [mode(x) for x in (0o100644, 0o40755, 0o120777, 0o104711, 0o102640, 0o41776)] == ["-rw-r--r--", "drwxr-xr-x", "lrwxrwxrwx", "-rws--x--x", "-rw-r-S---", "drwxrwxrwT"]


def test_salvage_and_damage(spark, tmp_path):
    make(tmp_path / "x.zip")
    data = (tmp_path / "x.zip").read_bytes()
    (tmp_path / "x.zip").write_bytes(data[: data.rfind(b"PK\5\6")])
    assert {r.name for r in ziparchive.read(spark, str(tmp_path), mode="SALVAGE").collect()} == set(FILES)
    at = data.find(b"b/two.bin") + 200
    (tmp_path / "x.zip").write_bytes(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])
    assert [r.idx for r in verify.contents(ziparchive.read(spark, str(tmp_path), "payloads")).collect()] == [1]


def test_writer(spark, tmp_path):
    rows = [("w.zip", n, d, datetime(2026, 1, 2, 3, 4, 6)) for n, d in FILES.items()]
    files = spark.createDataFrame(rows, "archive string, name string, content binary, mtime timestamp")
    assert zipwriter.write(zipwriter.packed(files), str(tmp_path)) == 1
    with zipfile.ZipFile(tmp_path / "w.zip") as z:
        assert z.testzip() is None and {i.filename: z.read(i) for i in z.infolist()} == FILES
    with pytest.raises(Exception, match="FileExistsError"):
        zipwriter.write(zipwriter.packed(files), str(tmp_path))


def test_split_volumes(spark, tmp_path):
    make(tmp_path / "x.zip")
    data = (tmp_path / "x.zip").read_bytes()
    for name, part in (("x.z01", data[:4000]), ("x.z02", data[4000:8000]), ("x.zip", data[8000:])):
        (tmp_path / name).write_bytes(part)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert ziparchive.tables_of(ziparchive.volumes(files)).count() == len(FILES)


def test_stream(spark, tmp_path):
    from archlake.streaming import dropfolder

    make(tmp_path / "x.zip")
    q = dropfolder.arriving(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.table("arrived").count() == len(FILES)


#: Fixed golden times: packed date and time, raw field, expected seconds.
TIMES = [
    ((1980, 1, 1, 0, 0, 0), 0, 0), ((2010, 1, 1, 0, 0, 0), 1262304000, 1262304000), ((2037, 12, 31, 0, 0, 0), 2145830400, 2145830400),
    ((2038, 1, 19, 3, 14, 8), 2147483648, 2147483648), ((2100, 1, 1, 0, 0, 0), 4102444800, 4102444800), ((1980, 1, 1, 0, 0, 0), 4294967295, -1),
    ((2001, 1, 1, 0, 0, 0), 2147483648, 978307200), ((1981, 1, 1, 0, 0, 0), 4294967295, 347155200),
]


def test_times(spark):
    pack = lambda y, m, d, h, i, s: (y - 1980) << 25 | m << 21 | d << 16 | h << 11 | i << 5 | s >> 1
    df = spark.createDataFrame([(pack(*d), r, w) for d, r, w in TIMES], "p long, r long, w long")
    assert not df.where(S.unix_from_extra(F.col("r"), F.col("p")) != F.col("w")).take(1)
    assert spark.range(1).select(S.dos_timestamp(F.lit(0).cast("long"))).first()[0] is None


def test_globs(spark):
    df = spark.createDataFrame([("a/b.txt",), ("ab.TXT",), ("a-b",), ("[x]",), ("a\nb",)], "name string")
    has = lambda p, **k: {r.name for r in df.where(glob.matches(F.col("name"), p, **k)).collect()}
    assert has("*.txt") == {"a/b.txt"} and has("*.txt", ignore_case=True) == {"a/b.txt", "ab.TXT"}
    assert has("*.txt", stop_at_dir=True) == set() and has("**.txt", stop_at_dir=True) == {"a/b.txt"}
    assert has("a?b") == {"a-b", "a\nb"} and has("a[!-]b") == {"a\nb"} and has("a[-/]b") == {"a-b"}
    assert has("a[b") == set() and has("a\\") == set() and has("[x]", sets=False) == {"[x]"} and has("\\[x]") == {"[x]"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    n = lambda x: F.lit(x).cast("long")
    assert one(S.permille(n(1000), n(250))) == 750 and one(S.permille(n(0), n(5))) == 0 and one(S.permille(n(100), n(150))) == -500
    assert one(S.percent(n(3), n(2))) == 33 and one(S.percent(n(0), n(2))) == 0
    assert [one(S.size_text(n(x))) for x in (0, 999, 1000, 10239, 10240, 1 << 20, 5 << 30)] == ["0", "999", "0.9K", "9.9K", "10K", "1.0M", "5.0G"]
    assert one(S.size_parse(F.lit("10M"))) == 10 << 20 and one(S.size_parse(F.lit("10Mx"))) is None
    assert one(S.escaped(F.lit("aé😀"))) == "a#U00e9#L01f600"
    assert one(S.safe_path(F.lit("/../a/./b"))) == "__/a/b"
    assert one(F.hex(S.le(n(258), 4))) == "02010000" and one(S.from_le(F.unhex(F.lit("0201")), 0, 2)) == 258


def test_sync_is_idempotent(spark):
    t = datetime(2026, 1, 1)
    fs = spark.createDataFrame([("z", "a", t, 1), ("z", "b", t, 2)], "archive string, name string, mtime timestamp, usize long")
    assert sync.is_current(fs, fs) and not sync.is_current(fs.limit(1), fs)


def test_packing_and_methods():
    for _ in range(50):
        sizes = [RNG.randint(1, 100) for _ in range(RNG.randint(1, 60))]
        bins = split.best_fit(sizes, 100)
        assert all(sum(s for s, b in zip(sizes, bins) if b == k) <= 100 for k in set(bins))
    assert optimize.selected("all,-winzip") == [10] and optimize.selected("store") == [0]
    with pytest.raises(ValueError):
        optimize.selected("store,-store")


def test_sizes_beyond_all_units(spark):
    """Units go on to T, and what has none gets a question mark, as the format's own tool writes it."""
    df = spark.createDataFrame([(10239 << 30,), (10240 << 30,), (15 << 40,), (999 << 40,), (1000 << 40,), (10240 << 40,)], "n long")
    assert [r[0] for r in df.select(S.size_text(F.col("n"))).collect()] == ["9.9T", "10T", "15T", "999T", "0.9?", "10?"]
