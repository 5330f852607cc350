"""Archives made from archives: copied, recompressed, with duplicates as references or without, split into smaller ones.

Takes the table `entries` of the archive source and gives rows for the writer.
Each rewrite keeps names, times, comments, attributes and fields; the fields
that only tell how the old archive was laid out are dropped.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archlake.functions import scalars as S
from archlake.operators import dedup, optimize, split
from archlake.sources import codecs, ziparchive, zipwriter

#: Fixed: field numbers of wide sizes, Unicode names and references' identifiers; the method of references.
WIDE, UNICODE_NAME, REFERENCE_ID, REFERENCE = 0x0001, 0x7075, 0x9903, 92


def _bytes(extras: Column, *without: int) -> Column:
    """Fields as bytes, in their order, those of these tags left out."""
    kept = F.filter(extras, lambda x: ~x["tag"].isin(*without))
    return F.aggregate(kept, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, S.le(x["tag"], 2), S.le(F.octet_length(x["data"]), 2), x["data"]))


def _held(entries: DataFrame) -> DataFrame:
    """Entries as Parquet in the folder of spark.checkpoint.dir: they are read several times, and each time would write and parse the archives again."""
    spark = entries.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    path = f"{top or 'file://' + tempfile.mkdtemp(prefix='archlake-')}/entries/{uuid.uuid4().hex}"
    entries.write.parquet(path)
    return spark.read.schema(entries.schema).parquet(path)


def copied(entries: DataFrame) -> DataFrame:
    """Every entry as it is: packed bytes, encrypted or not, are taken over unread."""
    drop = (WIDE, UNICODE_NAME)
    return entries.select(
        "archive", "idx", "name", "method", "payload", "crc", "usize", "dos_datetime", "comment", "host", "version_made", "internal_attr", "external_attr",
        F.col("flags").bitwiseAND(~0x800).alias("flags"), _bytes(F.col("local_extras"), *drop).alias("extra"), _bytes(F.col("extras"), *drop).alias("central_extra"),
    )


def _contents() -> Column:
    """Bytes of members that decode to their length and checksum, else null; references and encrypted ones are null."""
    raw = codecs.decoded(F.col("method"), F.col("payload"), F.col("flags"), F.col("usize"))
    return F.when(~F.col("encrypted") & (F.col("method") != REFERENCE), raw)


def optimized(entries: DataFrame, methods: str = "all") -> DataFrame:
    """The smallest form of each member among the methods of an expression; the present form stays at ties.

    A form counts only if it decodes to the same bytes. What is encrypted, a
    reference, a folder, or doesn't decode to its length and checksum stays
    as it is. A method not in the expression, or one never kept, gives way
    even to a larger form.
    """
    enabled = optimize.selected(methods)
    tried = [m for m in codecs.CODECS if m in enabled]
    stays = [m for m in enabled if m not in optimize.NEVER_KEPT]

    @F.pandas_udf(T.StructType([T.StructField("method", T.IntegerType()), T.StructField("payload", T.BinaryType())]))
    def best(method: pd.Series, payload: pd.Series, flags: pd.Series, usize: pd.Series, crc: pd.Series, fixed: pd.Series) -> pd.DataFrame:
        out = []
        for m, data, f, n, sum_, keep in zip(method, payload, flags, usize, crc, fixed):
            m, data = int(m), bytes(data)
            raw = None if keep else codecs.decode(m, data, int(f), int(n))
            choice = (m, data)
            if raw is not None and len(raw) == n and zlib.crc32(raw) == sum_:
                choice = (m, data) if m in stays else None
                for other in tried:
                    packed = codecs.encode(other, raw)
                    if (choice is None or len(packed) < len(choice[1])) and codecs.decode(other, packed, 0, len(raw)) == raw:
                        choice = (other, packed)
            out.append(choice or (m, data))
        return pd.DataFrame(out, columns=["method", "payload"])

    fixed = F.col("encrypted") | F.col("is_dir") | (F.col("method") == REFERENCE)
    chosen = entries.withColumn("b", best("method", "payload", "flags", "usize", "crc", fixed))
    # Flags 2 and 4 tell how the old method packed.
    flags = F.when(F.col("b.method") == F.col("method"), F.col("flags")).when(F.col("b.method") == 14, F.col("flags").bitwiseAND(~6).bitwiseOR(2)).otherwise(F.col("flags").bitwiseAND(~6))
    return copied(chosen.withColumn("flags", flags).withColumn("method", F.col("b.method")).withColumn("payload", F.col("b.payload")))


def _identifier(sha1: Column) -> Column:
    """16 bytes from a digest, marked as a random identifier."""
    h = F.sha1(F.concat(F.lit("reference source "), sha1))
    return F.unhex(F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 3), F.lit("a"), F.substring(h, 18, 15)))


def deduplicated(entries: DataFrame) -> DataFrame:
    """Later copies of a content as references to the first, where that saves bytes.

    Checksums and lengths, which catalogs have, say which members can have
    copies at all. Members are decoded where they lie, as finding those few
    first would move all payloads. Archives with nothing to gain come out as
    they are.
    """
    entries = _held(entries)
    alike = ["archive", "usize", "crc"]
    able = ~F.col("encrypted") & ~F.col("is_dir") & (F.col("method") != REFERENCE) & (F.col("usize") > 0)
    shared = entries.where(able).groupBy(*alike).agg(F.count("*").alias("n")).where("n > 1").select(*alike)
    digests = entries.where(able).select(*alike, "idx", F.sha1(_contents()).alias("sha1")).where("sha1 is not null").join(shared, alike, "left_semi").select("archive", "idx", "sha1")
    header = 30 + F.octet_length("raw_name") + F.octet_length(_bytes(F.col("local_extras")))
    layout = entries.select("archive", "idx", "usize", "csize", "method", F.col("offset").alias("off"), header.cast("long").alias("loclen"))
    layout = layout.withColumn("cd_offset", F.col("off") + F.col("loclen") + F.col("csize")).join(digests, ["archive", "idx"], "left")
    # What has no digest is alike to nothing, but bounds what lies before it.
    plan = dedup.plan(layout.withColumn("sha1", F.coalesce("sha1", F.concat(F.lit("member "), F.col("idx").cast("string")))))
    refs = plan.join(digests, ["archive", "idx"]).select("archive", "idx", "sha1", F.lit(True).alias("refers"))
    sources = plan.select("archive", F.col("source_idx").alias("idx")).distinct().join(digests, ["archive", "idx"]).select("archive", "idx", "sha1", F.lit(False).alias("refers"))
    marked = copied(entries).join(refs.unionByName(sources), ["archive", "idx"], "left")
    method = F.when(F.col("refers"), REFERENCE).otherwise(F.col("method"))
    own = _identifier(F.col("sha1"))
    field = F.concat(S.le(F.lit(REFERENCE_ID), 2), S.le(F.lit(20), 2), S.le(S.reference_checksum(method, F.col("dos_datetime"), F.col("crc"), own), 4), own)
    return (
        marked.withColumn("payload", F.when(F.col("refers"), F.unhex("sha1")).otherwise(F.col("payload")))
        .withColumn("flags", F.when(F.col("refers"), F.col("flags").bitwiseAND(0)).otherwise(F.col("flags")))
        .withColumn("central_extra", F.when(F.col("refers").isNotNull(), F.concat("central_extra", field)).otherwise(F.col("central_extra")))
        .withColumn("method", method)
        .drop("sha1", "refers")
    )


def expanded(entries: DataFrame) -> DataFrame:
    """Entries whose references hold their sources' packed bytes again; those without a source stay references."""
    entries = _held(entries)
    x = entries.withColumn("uuid", F.try_element_at(F.transform(F.filter("extras", lambda x: (x["tag"] == REFERENCE_ID) & (F.octet_length(x["data"]) == 20)), lambda x: F.substring(x["data"], 5, 16)), F.lit(1)))
    refs = x.where(F.col("method") == REFERENCE).select("archive", "idx", "usize", "crc", "uuid", F.lower(F.hex("payload")).alias("sha1"))
    able = x.where(~F.col("encrypted") & (F.col("method") != REFERENCE)).select("archive", "usize", "crc", "idx", F.sha1(_contents()).alias("sha1"), "uuid", F.col("offset").alias("off"))
    able = able.join(refs.select("archive", "usize", "crc").distinct(), ["archive", "usize", "crc"], "left_semi")
    found = dedup.resolve(refs, able.select("archive", "idx", "sha1", "uuid", "off")).where("source_idx is not null")
    sources = entries.select("archive", F.col("idx").alias("source_idx"), F.col("method").alias("s_method"), F.col("flags").alias("s_flags"), F.col("payload").alias("s_payload"))
    taken = found.join(sources, ["archive", "source_idx"]).drop("source_idx")
    out = entries.join(taken, ["archive", "idx"], "left")
    got = F.col("s_method").isNotNull()
    for c in ("method", "payload", "flags"):
        # Whether sums follow the data is the member's own affair.
        new = F.col("s_flags").bitwiseAND(~8).bitwiseOR(F.col("flags").bitwiseAND(8)) if c == "flags" else F.col(f"s_{c}")
        out = out.withColumn(c, F.when(got, new).otherwise(F.col(c)))
    out = out.withColumn("extras", F.when(got, F.filter("extras", lambda x: x["tag"] != REFERENCE_ID)).otherwise(F.col("extras")))
    return out.select(*entries.columns)


def parted(entries: DataFrame, capacity: int) -> DataFrame:
    """Archives of at most so many bytes each, best fit or in order, whichever needs fewer; a number follows the name."""
    rows = copied(entries)
    weights = rows.select("archive", "idx", split.weight(F.octet_length(F.encode("name", "UTF-8")), F.octet_length("payload"), F.octet_length("central_extra")).cast("long").alias("weight"))
    bins = split.assigned(weights, capacity - 22)
    name = F.concat(F.regexp_replace("archive", r"(?i)[.]zip$", ""), F.lpad((F.col("bin") + 1).cast("string"), 2, "0"), F.lit(".zip"))
    return rows.join(bins, ["archive", "idx"]).withColumn("archive", name).drop("bin")


def reread(rows: DataFrame, table: str = "entries", volume_size: int | None = None, arranged: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """What tables_of_pieces() reads of the archives that pieces() writes of these rows, by one worker that does both: a task needs no second one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from ziparchive.frames_of_pieces(zipwriter.pieces_of(parts, volume_size), table, mode)

    return zipwriter.in_order(rows, arranged).mapInPandas(run, ziparchive.SCHEMAS[table])


def noted(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """New names and comments of members. edits: archive, name, new_name, comment; a null leaves what there is, the first row of a name counts."""
    e = edits.groupBy("archive", "name").agg(F.first("new_name", ignorenulls=True).alias("new_name"), F.first("comment", ignorenulls=True).alias("new_comment"))
    j = rows.join(e, ["archive", "name"], "left")
    out = j.withColumn("name", F.coalesce("new_name", "name")).withColumn("comment", F.coalesce("new_comment", "comment"))
    return out.select(*rows.columns)
