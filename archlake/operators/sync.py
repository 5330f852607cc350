"""Archive against file system: each mode gives the actions it would take, as rows.

One full outer join by name and one ladder of conditions; members not named in
the selection keep their rows. Times are compared as packed ones are, in even
seconds; a folder's size on disk is -1. Actions: add, replace, copy, delete, skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def even(t: Column) -> Column:
    """Rounded up to an even second, as packed times are."""
    s = F.unix_timestamp(t)
    return F.timestamp_seconds(s + s % 2)


def _paired(members: DataFrame, fs: DataFrame) -> DataFrame:
    m = members.select("archive", "name", even(F.col("mtime")).alias("old_mtime"), F.col("usize").alias("old_usize"), F.lit(True).alias("in_archive"))
    f = fs.select("archive", "name", even(F.col("mtime")).alias("new_mtime"), F.col("usize").alias("new_usize"), F.lit(True).alias("on_disk"))
    return m.join(f, ["archive", "name"], "full_outer")


_BOTH = "in_archive and on_disk"
#: An entry is current also if it is empty and its file a folder; it differs not if it is a folder's on disk.
_CURRENT = "old_mtime = new_mtime and (old_usize = new_usize or old_usize = 0 and new_usize = -1)"
_SAME = "old_mtime = new_mtime and (old_usize = new_usize or name like '%/' and new_usize = -1)"


def _ladder(df: DataFrame, *steps: tuple[str, str], last: str) -> DataFrame:
    out = F.when(F.expr(steps[0][0]), steps[0][1])
    for cond, action in steps[1:]:
        out = out.when(F.expr(cond), action)
    return df.select("archive", "name", out.otherwise(last).alias("action"))


def add(members: DataFrame, fs: DataFrame) -> DataFrame:
    return _ladder(_paired(members, fs), (_BOTH, "replace"), ("on_disk", "add"), last="copy")


def update(members: DataFrame, fs: DataFrame) -> DataFrame:
    return _ladder(_paired(members, fs), (f"{_BOTH} and new_mtime > old_mtime", "replace"), ("in_archive", "copy"), last="add")


def freshen(members: DataFrame, fs: DataFrame) -> DataFrame:
    return _ladder(_paired(members, fs).where("in_archive"), ("on_disk and new_mtime > old_mtime", "replace"), last="copy")


def filesync(members: DataFrame, fs: DataFrame) -> DataFrame:
    return _ladder(_paired(members, fs), (f"{_BOTH} and {_CURRENT}", "copy"), (_BOTH, "replace"), ("on_disk", "add"), last="delete")


def is_current(members: DataFrame, fs: DataFrame) -> bool:
    """Whether a sync would write nothing."""
    return not filesync(members, fs).where("action <> 'copy'").take(1)


def difference(members: DataFrame, fs: DataFrame) -> DataFrame:
    return _ladder(_paired(members, fs).where(f"on_disk and not coalesce(in_archive and {_SAME}, false)"), ("in_archive", "replace"), last="add")


def between(t: Column, since=None, before=None) -> Column:
    out = F.lit(True)
    if since is not None:
        out = out & (t >= F.lit(since).cast("timestamp"))
    if before is not None:
        out = out & (t < F.lit(before).cast("timestamp"))
    return out


def delete(members: DataFrame, chosen: Column, since=None, before=None) -> DataFrame:
    """What is left: a date range limits what goes."""
    return members.where(~F.coalesce(chosen & between(F.col("mtime"), since, before), F.lit(False)))


def copy(members: DataFrame, chosen: Column, since=None, before=None) -> DataFrame:
    """What is chosen: a date range limits what stays."""
    return members.where(chosen & between(F.col("mtime"), since, before))


def extract(members: DataFrame, fs: DataFrame, policy: str = "update") -> DataFrame:
    """Policies: overwrite, never, freshen (only what is there and older), update (that, and what is missing)."""
    older = "on_disk and old_mtime > new_mtime"
    steps = {"overwrite": [("in_archive", "extract")], "never": [("on_disk", "skip")], "freshen": [(older, "extract"), ("true", "skip")], "update": [(older, "extract"), ("on_disk", "skip")]}[policy]
    return _ladder(_paired(members, fs).where("in_archive"), *steps, last="extract")


def dup_names(fs: DataFrame, inner: Column) -> DataFrame:
    """Different inputs that map to one internal name: an error. Repeated inputs count once."""
    return fs.select("archive", "name").distinct().groupBy("archive", inner.alias("internal")).agg(F.count("*").alias("inputs")).where("inputs > 1")
