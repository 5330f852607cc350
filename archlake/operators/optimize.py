"""The best codec for each member: candidates in a fixed order, the least size wins, earlier ones at ties."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlake.functions import scalars as S
from archlake.sources import codecs

#: Methods that can be tried here, and those that a group of that name takes of them.
CANDIDATES = sorted({*codecs.CODECS, *codecs.LEGACY})
GROUPS = {
    "all": CANDIDATES, "winzip": [m for m in CANDIDATES if m != 10], "pkzip1": [m for m in CANDIDATES if m <= 6], "pkzip2": [m for m in CANDIDATES if m <= 6 or m == 8],
    "reduce": [2, 3, 4, 5], "implode": [6], "dcl-implode": [10],
}
NEVER_KEPT = (16, 20, 99)


def selected(expression: str) -> list[int]:
    """Methods of a list read from the left: names and groups, `all` among them, with `-` removing; raises if unknown, not to be had here, or empty."""
    known = {name: n for n, name, _ in S.METHODS} | {"store": 0, "deflate": 8}
    out: set[int] = set()
    for token in re.split(r"\s*,\s*", expression.strip().lower()):
        minus, name = token.startswith("-"), token.lstrip("-")
        some = GROUPS.get(name) or ([known[name]] if name in known else None)
        if some is None or not minus and not set(some) <= set(CANDIDATES):
            raise ValueError(f"unknown method: {token}")
        out = out - set(some) if minus else out | set(some)
    if not out:
        raise ValueError("no method is left")
    return sorted(out)


def ranked(members: DataFrame, sizes: DataFrame, enabled: list[int]) -> DataFrame:
    """members: archive, idx, method, csize; sizes: archive, idx, code, method, csize. The best of each member."""
    kept = members.where(F.col("method").isin(*enabled) & ~F.col("method").isin(*NEVER_KEPT)).select("archive", "idx", F.lit(-1).alias("code"), "method", "csize")
    both = kept.unionByName(sizes.where(F.col("method").isin(*enabled)).select("archive", "idx", "code", "method", "csize"))
    best = both.groupBy("archive", "idx").agg(F.min_by(F.struct("code", "method", "csize"), F.struct("csize", "code")).alias("b"))
    return best.select("archive", "idx", F.col("b.method").alias("best_method"), F.col("b.csize").alias("best_csize"), (F.col("b.code") < 0).alias("kept_original"))


def encode_all(members: DataFrame, data_col: str = "data") -> DataFrame:
    """Each member's size by each codec here, bytes given back checked."""
    x = members.select("archive", "idx", F.posexplode(codecs.candidate_sizes(F.col(data_col))).alias("code", "c"))
    return x.select("archive", "idx", "code", "c.method", "c.csize", "c.ok")
