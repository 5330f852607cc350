"""Searches in members' contents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(text: Column, pattern: str, ignore_case: bool = False, whole_words: bool = False) -> Column:
    if whole_words:
        return text.rlike(rf"{'(?i)' if ignore_case else ''}(?<![A-Za-z0-9_]){re.escape(pattern)}(?![A-Za-z0-9_])")
    return F.upper(text).contains(pattern.upper()) if ignore_case else text.contains(pattern)


def lines(members: DataFrame, regex: str, text_col: str = "text") -> DataFrame:
    """Members' lines that a regular expression fits, with their numbers."""
    one = members.where(F.col(text_col).rlike(f"(?m){regex}")).select("archive", "name", F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    return one.where(F.col("line").rlike(regex)).select("archive", "name", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def names(members: DataFrame, regex: str) -> DataFrame:
    return lines(members, regex).select("archive", "name").distinct()
