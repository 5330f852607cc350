"""Checks whose findings are rows: archive, idx, check, severity, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlake.functions import extras as X
from archlake.sources import codecs, crypto

from . import spans


def _found(df: DataFrame, check: str, severity: int, detail: Column) -> DataFrame:
    return df.select("archive", "idx", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def headers(members: DataFrame, local: DataFrame, fields: tuple[str, ...] = ("method", "flags", "dos_datetime", "crc", "csize", "usize", "raw_name")) -> DataFrame:
    """Fields in which local header and catalog differ; sizes and sums after the data don't count where flagged so."""
    late = F.col("m.flags").bitwiseAND(8) != 0 if "flags" in members.columns else F.lit(False)
    j = members.alias("m").join(local.alias("l"), ["archive", "idx"])
    differs = [F.when(~F.col(f"m.{f}").eqNullSafe(F.col(f"l.{f}")) & (~late if f in ("crc", "csize", "usize") else F.lit(True)), F.lit(f)) for f in fields]
    out = j.select("archive", "idx", F.array_compact(F.array(*differs)).alias("fields")).where("size(fields) > 0")
    return _found(out, "header", 2, F.concat_ws(",", "fields"))


def contents(payloads: DataFrame, password: bytes | None = None) -> DataFrame:
    """Members that can't be opened or decoded, or not to their length and checksum, which AES in its second form leaves to its tag."""
    d = crypto.decrypted(payloads, password) if password is not None else payloads
    d = d.withColumn("raw", F.when(~F.col("encrypted"), codecs.decoded(F.col("method"), F.col("payload"), F.col("flags"), F.col("usize"))))
    why = F.when(F.col("encrypted"), "encrypted").when(F.col("raw").isNull(), "not decoded").when(F.octet_length("raw") != F.col("usize"), "length").when((F.col("aes_version") != 2) & (F.crc32("raw") != F.col("crc")), "checksum")
    return _found(d.withColumn("why", why).where("why is not null"), "content", 3, F.col("why"))


def layout(taken: DataFrame) -> DataFrame:
    """taken: archive, idx, beg, end of members' bytes. Those that begin before an earlier one has ended, and bytes before one that none has."""
    over, gap = spans.overlaps(taken), spans.gaps(taken)
    return _found(over, "overlap", 3, F.col("reached") - F.col("beg")).unionByName(_found(gap, "gap", 1, F.col("gap_bytes")))


def fields(members: DataFrame, known: tuple[int, ...]) -> DataFrame:
    """Members with extra fields of other tags than the known ones, which their detail names, or with two of one tag."""
    odd = F.transform(F.filter("extras", lambda x: ~x["tag"].isin(*known)), lambda x: F.hex(x["tag"]))
    why = F.when(F.size(odd) > 0, F.concat_ws(",", odd)).when(X.has_duplicates(F.col("extras")), "repeated")
    return _found(members.withColumn("why", why).where("why is not null"), "field", 2, F.col("why"))


def strict(members: DataFrame, local: DataFrame, known: tuple[int, ...]) -> DataFrame:
    """What strict reading refuses: headers that differ, members' bytes that overlap or leave gaps, fields that aren't known. Members with sums after their data end where the next begins."""
    taken = members.join(local.select("archive", "idx", "data_offset"), ["archive", "idx"])
    late, end = F.col("flags").bitwiseAND(8) != 0, F.col("data_offset") + F.col("csize")
    after = F.lead("offset").over(Window.partitionBy("archive").orderBy("offset", "idx"))
    taken = taken.select("archive", "idx", F.col("offset").alias("beg"), F.when(late & after.isNotNull(), F.greatest(end, after)).otherwise(end).alias("end"))
    return headers(members, local).unionByName(layout(taken)).unionByName(fields(members, known))


def signatures(members: DataFrame) -> DataFrame:
    """Members whose content, in `raw`, hasn't the MD5 that their signature field, in `extras`, holds; without such a field nothing is found."""
    stored = X.fwkcs_md5(F.col("extras"))
    return _found(members.where(stored.isNotNull() & (stored != F.md5("raw"))), "signature", 2, stored)


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side alone, with how often: empty when both hold the same."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def summary(violations: DataFrame, archives: DataFrame) -> DataFrame:
    """Each archive's number of findings and worst severity, 0 for none."""
    v = violations.groupBy("archive").agg(F.count("*").alias("findings"), F.max("severity").alias("severity"))
    return archives.select("archive").join(v, "archive", "left").select("archive", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("severity", F.lit(0)).alias("severity"))


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first byte in which two values differ, by halving; null if they are equal."""
    x, y = F.hex(a), F.hex(b)
    n = F.least(F.length(x), F.length(y)) / 2
    at = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.struct(F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(F.substr(x, F.lit(1), ((s["lo"] + s["hi"] + 1) / 2).cast("long").cast("int") * 2) == F.substr(y, F.lit(1), ((s["lo"] + s["hi"] + 1) / 2).cast("long").cast("int") * 2),
                   F.struct(((s["lo"] + s["hi"] + 1) / 2).cast("long").alias("lo"), s["hi"].alias("hi"))
            ).otherwise(F.struct(s["lo"].alias("lo"), (((s["lo"] + s["hi"] + 1) / 2).cast("long") - 1).alias("hi")))),
    )["lo"]
    return F.when(a != b, at)


def paired(index: DataFrame) -> DataFrame:
    """index: id and role. Each id's rows in order, companions before their owner."""
    return index.select("id", "role", F.row_number().over(Window.partitionBy("id").orderBy(F.col("role") == "owner")).alias("place"))


def owners(index: DataFrame) -> DataFrame:
    """index: id, role (owner or companion), mode. Ids without exactly one owner, or without the companion that mode 2 asks for and no other."""
    g = index.groupBy("id").agg(F.sum((F.col("role") == "owner").cast("int")).cast("long").alias("owners"), F.sum((F.col("role") == "companion").cast("int")).cast("long").alias("companions"), F.max("mode").alias("mode"))
    bad = (F.col("owners") != 1) | (F.col("companions") != (F.col("mode") == 2).cast("int"))
    return g.where(F.coalesce(bad, F.lit(True)))


def with_companions(chosen: DataFrame, index: DataFrame) -> DataFrame:
    """Chosen owners' ids carry their companions along."""
    return index.join(chosen.select("id").distinct(), "id", "left_semi")


_RESERVED = r"^__XTRO_ZIP__/x/([0-9a-f]{32})\.xtm$"


def companion_id(name: Column) -> Column:
    x = F.regexp_extract(name, _RESERVED, 1)
    return F.when(x != "", F.unhex(x))


def companion_name(owner: Column) -> Column:
    return F.concat(F.lit("__XTRO_ZIP__/x/"), F.lower(F.hex(owner)), F.lit(".xtm"))
