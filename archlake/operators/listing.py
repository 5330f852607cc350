"""Listings of members, their totals and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.functions import scalars as S


#: Fixed: short names of the systems that an archive's members were made on, by number from 0 on; 30 is "ath", others "???".
HOSTS = ["fat", "ami", "vms", "unx", "cms", "atr", "hpf", "mac", "zzz", "cpm", "t20", "ntf", "qds", "aco", "vft", "mvs", "be ", "nsk", "ths", "osx"]
#: Fixed: systems whose members have DOS attributes: FAT, CMS, HPFS, NTFS, Acorn, VFAT, MVS.
_DOS_HOSTS = (0, 4, 6, 11, 13, 14, 15)
#: Fixed: short names of methods; deflate's and implode's end in what their flags say.
_CODES = {0: "stor", 1: "shrk", 2: "re:1", 3: "re:2", 4: "re:3", 5: "re:4", 7: "tokn", 10: "dcli", 12: "bzp2", 14: "lzma", 93: "zstd", 92: "rptr", 94: "mp3", 95: "xz", 96: "wj96", 97: "wavp", 98: "ppmd"}


def data_size(members: DataFrame) -> Column:
    """Packed size without what encryption adds to it, where that is known."""
    if "encrypted" not in members.columns:
        return F.col("csize")
    added = S.encryption_overhead(F.col("encrypted"), F.col("aes_version"), F.col("aes_strength"))
    return F.when(added <= F.col("csize"), F.col("csize") - added).otherwise(F.col("csize"))


def verbose(members: DataFrame) -> DataFrame:
    """Sizes, method, ratio, time and name; the checksum too where members have it."""
    size = data_size(members)
    milli = S.permille(F.col("usize"), size)
    crc = [F.lower(F.lpad(F.hex("crc"), 8, "0")).alias("crc")] if "crc" in members.columns else []
    return members.select("archive", "idx", "usize", S.method_name(F.col("method")).alias("method"), size.alias("csize"), milli.alias("ratio_permille"), S.listed_percent(milli).alias("ratio_percent"), F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("modified"), *crc, "name")


def unix_mode(mode: Column) -> Column:
    """Sixteen bits of a Unix mode as ten characters."""
    has = lambda bit: mode.bitwiseAND(bit) != 0
    kind = F.lit("?")
    for number, letter in ((4, "d"), (8, "-"), (10, "l"), (6, "b"), (2, "c"), (1, "p"), (12, "s")):
        kind = F.when(F.shiftright(mode, 12) == number, letter).otherwise(kind)
    out = [kind]
    for r, special, letter in ((0o400, 0o4000, "s"), (0o040, 0o2000, "s"), (0o004, 0o1000, "t")):
        run = F.when(has(special), F.when(has(r >> 2), letter).otherwise(letter.upper())).otherwise(F.when(has(r >> 2), "x").otherwise("-"))
        out += [F.when(has(r), "r").otherwise("-"), F.when(has(r >> 1), "w").otherwise("-"), run]
    return F.concat(*out)


def dos_mode(attributes: Column, name: Column) -> Column:
    """DOS attributes as seven characters; programs, by their name's end, and folders can be run."""
    has = lambda bit: attributes.bitwiseAND(bit) != 0
    volume = attributes.bitwiseAND(0x18) == 8
    kind = F.when(volume, "V").when(has(0x10), "d").otherwise("-")
    run = has(0x10) | (~volume & name.rlike(r"(?i)[.](com|exe|btm|cmd|bat)[^.]*$"))
    letter = lambda bit, x: F.when(has(bit), x).otherwise("-")
    return F.concat(kind, F.lit("r"), F.when(has(1), "-").otherwise("w"), F.when(run, "x").otherwise("-"), letter(0x20, "a"), letter(2, "h"), letter(4, "s"))


def method_code(method: Column, flags: Column) -> Column:
    """Short name of a method, with deflate's level and implode's tables from the flags."""
    level = F.element_at(F.array(*map(F.lit, "NXFS")), F.shiftright(flags, 1).bitwiseAND(3) + 1)
    has = lambda bit, yes, no: F.when(flags.bitwiseAND(bit) != 0, yes).otherwise(no)
    out = F.when(method > 999, F.lpad(F.hex(method), 4, "0")).otherwise(F.concat(F.lit("u"), F.lpad(method.cast("string"), 3, "0")))
    for number, code in _CODES.items():
        out = F.when(method == number, code).otherwise(out)
    return F.when(method == 8, F.concat(F.lit("def"), level)).when(method == 9, F.concat(F.lit("d64"), level)).when(method == 6, F.concat(F.lit("i"), has(2, "8", "4"), F.lit(":"), has(4, "3", "2"))).otherwise(out)


def columns(members: DataFrame) -> DataFrame:
    """What a line of the short listing has: mode, version and system that made the member, sizes, kind (t or b, capital if encrypted), x, X, l or - for extra fields and sums after the data, percent saved, code of the method.

    Members as a catalog has them. Modes are of Unix or DOS, those of VMS,
    Amiga and THEOS are shown as if of Unix.
    """
    mode, host, low = F.shiftright("external_attr", 16).bitwiseAND(0xFFFF).cast("int"), F.col("host"), F.col("external_attr").bitwiseAND(0xFF).cast("int")
    flags, internal = F.col("flags"), F.col("internal_attr")
    # FAT members may carry a Unix mode, which is right if it agrees with the DOS attributes.
    agrees = mode.bitwiseAND(0o700) == F.lit(0o400) + F.when(low.bitwiseAND(1) == 0, 0o200).otherwise(0) + F.when(low.bitwiseAND(0x10) != 0, 0o100).otherwise(0)
    dos = host.isin(*_DOS_HOSTS) & ((internal.bitwiseAND(4) != 0) | (host != 0) | ~agrees)
    system = F.when(host == 30, "ath").otherwise(F.coalesce(F.get(F.array(*map(F.lit, HOSTS)), host), F.lit("???")))
    text, locked, late = internal.bitwiseAND(1) != 0, flags.bitwiseAND(1) != 0, flags.bitwiseAND(8) != 0
    extra = (F.size("extras") > 0) | (host.isin(3, 6, 11) & (F.col("external_attr").bitwiseAND(0x8000) != 0))
    sealed = (F.col("method") == 99) & (F.col("aes_version") > 0)
    code = F.when(sealed, F.concat(method_code(F.col("real_method"), flags), F.lit("/AE"), F.col("aes_version").cast("string"))).otherwise(method_code(F.col("method"), flags))
    return members.select(
        "archive", "name", F.when(dos, dos_mode(low, F.col("name"))).otherwise(unix_mode(mode)).alias("mode"), F.concat(S.div(F.col("version_made"), F.lit(10)).cast("string"), F.lit("."), (F.col("version_made") % 10).cast("string")).alias("version"),
        system.alias("host"), "usize", "csize", F.when(locked, F.when(text, "T").otherwise("B")).otherwise(F.when(text, "t").otherwise("b")).alias("kind"),
        F.when(extra, F.when(late, "X").otherwise("x")).otherwise(F.when(late, "l").otherwise("-")).alias("fields"), S.listed_percent(S.permille(F.col("usize"), data_size(members))).alias("percent"), code.alias("code"),
    )


def totals(members: DataFrame, *by: str) -> DataFrame:
    sums = members.groupBy(*by).agg(F.count("*").alias("files"), F.sum("usize").alias("usize"), F.sum("csize").alias("csize"))
    return sums.withColumn("ratio_permille", S.permille(F.col("usize"), F.col("csize")))


def with_total(members: DataFrame) -> DataFrame:
    """Totals of each archive and, with a null archive, of all."""
    sums = members.rollup("archive").agg(F.count("*").alias("files"), F.sum("usize").alias("usize"), F.sum("csize").alias("csize"))
    return sums


def info(members: DataFrame, form: str = "m") -> DataFrame:
    """Forms 1 (names), s (short), m (medium, with ratio), l (long, with packed size)."""
    name = [F.col("archive"), F.col("name")]
    if form == "1":
        return members.select(*name)
    code = F.when(F.col("method") == 0, "stor").when(F.col("method") == 8, "defl").when(F.col("method") == 12, "bzp2").when(F.col("method") == 14, "lzma").otherwise(F.concat(F.lit("u"), F.lpad(F.col("method").cast("string"), 3, "0")))
    cols = [*name, F.col("usize"), code.alias("code"), F.date_format("mtime", "yy-MMM-dd HH:mm").alias("modified")]
    if form == "m":
        cols.append(S.listed_percent(S.permille(F.col("usize"), F.col("csize"))).alias("percent"))
    if form == "l":
        cols.append(F.col("csize"))
    return members.select(*cols)


def latest(members: DataFrame, *by: str) -> DataFrame:
    """Latest time and number of all that are no directories."""
    return members.where(~F.col("name").endswith("/")).groupBy(*by).agg(F.max("mtime").alias("latest"), F.count("*").alias("files"))


def method_tally(members: DataFrame) -> DataFrame:
    return members.groupBy("method").agg(F.count("*").alias("files")).orderBy("files", "method")


def progress(members: DataFrame) -> DataFrame:
    """Files and bytes so far and left, in each archive's order."""
    from pyspark.sql import Window

    whole = Window.partitionBy("archive")
    so_far = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return members.select("archive", "idx", F.count("*").over(so_far).alias("files_done"), F.sum("usize").over(so_far).alias("bytes_done"), (F.sum("usize").over(whole) - F.sum("usize").over(so_far)).alias("bytes_left"))


def at(members: DataFrame, index: int) -> DataFrame:
    return members.where(F.col("idx") == index)


def unmatched(members: DataFrame, patterns: list[str], **how) -> DataFrame:
    """Patterns that fit no member; one pass over the members, one row for each pattern at most."""
    from archlake.functions import glob

    hits = F.array(*[F.when(glob.matches(F.col("name"), p, **how), F.lit(p)) for p in patterns])
    found = members.select(F.explode(F.array_compact(hits)).alias("pattern")).distinct()
    return members.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string").join(found, "pattern", "left_anti")
