"""Rules that whole hours, plain texts and intact members don't show."""

import pytest
from pyspark.sql import functions as F

from archlake.functions import scalars as S
from archlake.operators import optimize, split, sync
from archlake.sources import codecs


def test_text_by_its_bytes(spark):
    rows = [(i, chr(i)) for i in range(0, 34)] + [(100, ""), (101, "a\x1cb"), (102, "é"), (103, "a\x1ab"), (104, "\x1b\t")]
    got = {r.i: (r.text, r.strict) for r in spark.createDataFrame(rows, "i int, t string").select("i", S.is_text(F.col("t")).alias("text"), S.is_text_buffer(F.col("t")).alias("strict")).collect()}
    black = {*range(7), *range(14, 26), *range(28, 32)}
    assert {i: got[i] for i in range(34)} == {i: (i not in black, i >= 32) for i in range(34)}
    assert [got[i] for i in range(100, 105)] == [(True, False), (False, False), (True, True), (True, True), (True, False)]


def test_sync_compares_even_seconds_and_folders(spark):
    old = [("a", "f", "2024-01-01 00:00:02", 5), ("a", "g", "2024-01-01 00:00:02", 5), ("a", "d/", "2024-01-01 00:00:02", 0), ("a", "e/", "2024-01-01 00:00:02", 3), ("a", "h", "2024-01-01 00:00:02", 5)]
    new = [("a", "f", "2024-01-01 00:00:01", 5), ("a", "g", "2024-01-01 00:00:03", 5), ("a", "d/", "2024-01-01 00:00:02", -1), ("a", "e/", "2024-01-01 00:00:02", -1), ("a", "h", "2024-01-01 00:00:02", 6)]
    schema = "archive string, name string, t string, usize long"
    m, f = (spark.createDataFrame(x, schema).withColumn("mtime", F.col("t").cast("timestamp")) for x in (old, new))
    actions = lambda df: {r.name: r.action for r in df.collect()}
    assert actions(sync.filesync(m, f)) == {"f": "copy", "g": "replace", "d/": "copy", "e/": "replace", "h": "replace"}
    assert actions(sync.difference(m, f)) == {"g": "replace", "h": "replace"}
    assert actions(sync.update(m, f)) == {"f": "copy", "g": "replace", "d/": "copy", "e/": "copy", "h": "copy"}
    assert actions(sync.extract(m, f, "freshen")) == {"f": "skip", "g": "skip", "d/": "skip", "e/": "skip", "h": "skip"}


def test_method_groups():
    assert optimize.selected("all") == optimize.CANDIDATES and optimize.selected("winzip") == [m for m in optimize.CANDIDATES if m != 10]
    assert optimize.selected("pkzip1") == [0, 1, 2, 3, 4, 5, 6] and optimize.selected("pkzip2") == [0, 1, 2, 3, 4, 5, 6, 8]
    assert optimize.selected("pkzip2,-reduce,-deflate") == [0, 1, 6] and optimize.selected("dcl-implode") == [10]
    for bad in ("8", "nothing", "all,-all", "ppmd"):
        with pytest.raises(ValueError):
            optimize.selected(bad)


@pytest.mark.parametrize("method", sorted(codecs.CODECS))
def test_decoders_stop_beyond_the_length(method):
    data = bytes(200_000)
    packed = codecs.encode(method, data)
    assert codecs.decode(method, packed, 0, len(data)) == data == codecs.decode(method, packed)
    assert len(codecs.decode(method, packed, 0, 1000)) == 1001


def test_sequential_split(spark):
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate([6, 4, 1, 9, 2, 10])] + [("b", 0, 3)], "archive string, idx long, weight long")
    assert sorted((r.archive, r.idx, r.bin) for r in split.sequential(df, 10).collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("a", 5, 3), ("b", 0, 0)]
    with pytest.raises(Exception, match="larger than a part"):
        split.sequential(df, 9).collect()


def test_histogram_counts_bytes(spark):
    got = spark.createDataFrame([("é\n",)], "t string").select(F.explode(S.byte_values(F.encode("t", "UTF-8"))).alias("b")).collect()
    assert [r.b for r in got] == ["C3", "A9", "0A"]
