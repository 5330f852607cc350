"""Extra fields as an array of (tag, data) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

TYPE = "array<struct<tag:int,data:binary>>"


def lookup(extras: Column, tag: int) -> Column:
    """Data of the first field of a tag, or null."""
    return F.try_element_at(F.filter(extras, lambda x: x["tag"] == tag), F.lit(1))["data"]


def last(extras: Column, tag: int) -> Column:
    return F.try_element_at(F.filter(extras, lambda x: x["tag"] == tag), F.lit(-1))["data"]


def has_duplicates(extras: Column) -> Column:
    return F.size(F.array_distinct(F.transform(extras, lambda x: x["tag"]))) < F.size(extras)


def without(extras: Column, *tags: int) -> Column:
    return F.filter(extras, lambda x: ~x["tag"].isin(*tags))


def merged(old: Column, new: Column) -> Column:
    """The new fields and those old ones whose tag is not among them."""
    tags = F.transform(new, lambda x: x["tag"])
    return F.concat(new, F.filter(old, lambda x: ~F.array_contains(tags, x["tag"])))


def append(extras: Column, tag: int, data: Column) -> Column:
    return F.array_append(extras, F.struct(F.lit(tag).alias("tag"), data.alias("data")))


def ascending(extras: Column) -> Column:
    """Tags strictly ascending, so unique."""
    tags = F.transform(extras, lambda x: x["tag"])
    return tags == F.array_sort(F.array_distinct(tags))


def entry_time(extras: Column) -> Column:
    """The modification time, 32 bits unsigned, of the timestamp field whose flags say that it is there; else null."""
    d = lookup(extras, 0x5455)
    flags = F.conv(F.hex(F.substring(d, 1, 1)), 16, 10).cast("int")
    return F.when((F.octet_length(d) >= 5) & (flags.bitwiseAND(1) == 1), S.from_le(d, 1, 4).cast("long"))


def fwkcs_md5(extras: Column) -> Column:
    """Hex MD5 of the `MD5` content-signature field, or null."""
    d = lookup(extras, 0x4B46)
    return F.when((F.length(d) == 19) & (F.substring(d, 1, 3) == F.lit("MD5").cast("binary")), F.lower(F.hex(F.substring(d, 4, 16))))


def as_map(extras: Column) -> Column:
    """Tag to data; null where a tag is there twice."""
    return F.when(~has_duplicates(extras), F.map_from_entries(extras))
