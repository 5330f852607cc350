"""Archives split into parts of a size: in order, or best-fit decreasing."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight(name_length: Column, csize: Column, extra: Column | None = None) -> Column:
    """Bytes a member takes in a part: both headers with its name in each, and its data."""
    return F.lit(8 + 30 + 46) + 2 * name_length + csize + (2 * extra if extra is not None else 0)


def sequential(members: DataFrame, capacity: int) -> DataFrame:
    """Bins in member order, a new one at overflow; members beyond the capacity raise. One task holds an archive's numbers and weights and goes over them once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        if len(pdf) and pdf["weight"].max() > capacity:
            raise ValueError("a member is larger than a part")
        bins, used, out = 0, 0, []
        for w in pdf["weight"].tolist():
            if used + w > capacity:
                bins, used = bins + 1, 0
            used += w
            out.append(bins)
        return pdf.assign(bin=out)[["archive", "idx", "bin"]]

    return members.select("archive", "idx", "weight").groupBy("archive").applyInPandas(run, "archive string, idx long, bin int")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size, largest first, each into the fullest bin that takes it."""
    out, rooms = [0] * len(sizes), []
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b, n = capacity, n, n + 1
        bisect.insort(rooms, (room - sizes[i], b))
        out[i] = b
    return out


def greedy(members: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing in each archive, whose members (not their bytes) one task holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pdf.assign(bin=best_fit(pdf["weight"].tolist(), capacity))[["archive", "idx", "bin"]]

    return members.select("archive", "idx", "weight").groupBy("archive").applyInPandas(run, "archive string, idx long, bin int")


def assigned(members: DataFrame, capacity: int) -> DataFrame:
    """Best fit where it needs strictly fewer parts, else in order."""
    s, g = sequential(members, capacity), greedy(members, capacity)
    count = lambda df, c: df.groupBy("archive").agg(F.max("bin").alias(c))
    better = count(s, "s").join(count(g, "g"), "archive").where("g < s").select("archive")
    return s.join(better, "archive", "left_anti").unionByName(g.join(better, "archive", "left_semi"))


def efficiency(members: DataFrame, bins: DataFrame, capacity: int) -> DataFrame:
    """Least possible parts against used ones, in percent."""
    total = members.groupBy("archive").agg(F.sum("weight").alias("total"))
    used = bins.groupBy("archive").agg((F.max("bin") + 1).cast("long").alias("parts"))
    return total.join(used, "archive").select("archive", "parts", F.expr(f"(100 * ((total + {capacity - 1}) div {capacity})) div parts").alias("efficiency"))
