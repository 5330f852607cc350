"""Comments to texts and back."""

import pytest
from pyspark.sql import functions as F

from archlake.operators import notes

ROWS = [("x", 1, "a b", "mail me @ home \\ work\nsecond"), ("x", 2, "empty", ""), ("x", 3, "null", None), ("y", 1, "c", "@ (comment above this line)\n@=no\ttab\x07")]


def test_texts_and_back(spark):
    m = spark.createDataFrame(ROWS, "archive string, idx long, name string, comment string")
    own = spark.createDataFrame([("x", "of @x\n")], "archive string, comment string")
    t = notes.dumped(m, own)
    assert {r.archive: r.text for r in t.collect()}["x"] == (
        "@ a b\nmail me \\@ home \\\\ work\nsecond\n@ (comment above this line)\n@ empty\n@ (comment above this line)\n@ null\n@ (comment above this line)\n@ (zip file comment below this line)\nof \\@x\n"
    )
    got = {(r.archive, r.name): (r.new_name, r.comment) for r in notes.edits(t).collect()}
    assert got == {(a, n): (None, (c or "").replace("\x07", "")) for a, _, n, c in ROWS}
    assert {r.archive: r.comment for r in notes.archive_comments(t).collect()} == {"x": "of @x", "y": ""}
    assert notes.dumped(m.limit(0)).count() == 0


def test_edited(spark):
    text = "@ a b\r\n@=new name\r\nline\r\n@ (comment above this line)\r\n@ lost\r\n"
    e = notes.edits(spark.createDataFrame([("x", text)], "archive string, text string"))
    assert {tuple(r) for r in e.collect()} == {("x", "a b", "new name", "line"), ("x", "lost", None, "")}
    m = spark.createDataFrame(ROWS, "archive string, idx long, name string, comment string")
    assert [r.name for r in notes.unknown(e, m).collect()] == ["lost"]
    bad = spark.createDataFrame([("x", "stray\n@ a\n")], "archive string, text string")
    with pytest.raises(Exception, match="before the first mark"):
        notes.edits(bad).select(F.sum(F.length("comment"))).collect()
