"""Members' comments as a text to edit, and edited texts as rows of changes.

All in the JVM; an archive's text is as large as its catalog, which one task
holds anyway. Names with line feeds can't be said in such a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: lines of the text. A name's line may be followed by `@=` and a new name.
ABOVE, BELOW = "(comment above this line)", "(zip file comment below this line)"


def _clean(comment: Column) -> Column:
    """Without control characters other than tab and line feed, marks and backslashes escaped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(comment, F.lit("")), r"[\x00-\x08\x0B-\x1F]", ""), r"([@\\])", r"\\$1")


def _lines(comment: Column) -> Column:
    c = F.regexp_replace(_clean(comment), "\n+$", "")
    return F.when(c == "", "").otherwise(F.concat(c, F.lit("\n")))


def dumped(members: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """archive and text. members: archive, idx, name, comment; archives, if given: archive, comment."""
    one = F.concat(F.lit("@ "), "name", F.lit("\n"), _lines(F.col("comment")), F.lit(f"@ {ABOVE}\n"))
    t = members.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("idx", one.alias("t")))).alias("t"))
    if archives is None:
        own = t.withColumn("own", F.lit(""))
    else:
        own = t.join(archives.select("archive", _lines(F.col("comment")).alias("own")), "archive", "left")
    body = F.array_join(F.transform("t", lambda x: x["t"]), "")
    return own.select("archive", F.concat(body, F.lit(f"@ {BELOW}\n"), F.coalesce("own", F.lit(""))).alias("text"))


def _sections(notes: DataFrame) -> DataFrame:
    """archive, at, head (the line of the mark) and body, for each mark; text before the first mark raises."""
    s = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n", "\n")), "\n@ ")
    # The marks' own lines start sections, so an empty first one means that nothing comes before.
    s = F.when(F.trim(F.regexp_replace(s[0], "\n", "")) == "", s).otherwise(F.raise_error(F.lit("text before the first mark")))
    x = notes.select("archive", F.posexplode(s).alias("at", "s")).where("at > 0")
    return x.select("archive", "at", F.substring_index("s", "\n", 1).alias("head"), F.regexp_replace(F.expr("substr(s, length(substring_index(s, '\n', 1)) + 2)"), "\n+$", "").alias("body"))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([@\\])", "$1")


def edits(notes: DataFrame) -> DataFrame:
    """archive, name, new_name, comment of each member a text names, for rewrite.noted. notes: archive, text. No lines: an empty comment."""
    x = _sections(notes).where(~F.col("head").isin(ABOVE, BELOW))
    renames = F.col("body").startswith("@=")
    new = F.when(renames, F.regexp_replace(F.substring_index("body", "\n", 1), "^@=", ""))
    rest = F.when(renames, F.regexp_replace("body", r"^[^\n]*\n?", "")).otherwise(F.col("body"))
    return x.select("archive", F.col("head").alias("name"), new.alias("new_name"), _plain(rest).alias("comment"))


def archive_comments(notes: DataFrame) -> DataFrame:
    """archive and comment, of texts that have its line."""
    return _sections(notes).where(F.col("head") == BELOW).select("archive", _plain(F.col("body")).alias("comment"))


def unknown(edits: DataFrame, members: DataFrame) -> DataFrame:
    """Edits of names that the archives don't have."""
    return edits.join(members.select("archive", "name"), ["archive", "name"], "left_anti")
