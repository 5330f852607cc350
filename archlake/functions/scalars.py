"""Column builders for sizes, ratios, packed times, texts and names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: method numbers of the format, their names and the least version that reads them.
METHODS = [
    (0, "stored", 10), (1, "shrunk", 10), (2, "reduced-1", 10), (3, "reduced-2", 10), (4, "reduced-3", 10), (5, "reduced-4", 10),
    (6, "imploded", 10), (8, "deflated", 20), (9, "deflate64", 21), (10, "dcl-imploded", 25), (12, "bzip2", 46), (14, "lzma", 63),
    (16, "cmpsc", 63), (18, "terse", 63), (20, "zstd-old", 63), (92, "reference", 63), (93, "zstd", 63), (94, "mp3", 63), (95, "xz", 63),
    (96, "jpeg", 63), (97, "wavpack", 63), (98, "ppmd", 63), (99, "encrypted", 51),
]


def div(a: Column, b: Column) -> Column:
    """Whole-number division toward zero."""
    return F.call_function("div", a, b)


def permille(full: Column, packed: Column) -> Column:
    """Saved parts in a thousand, rounded away from zero; coarse above two million bytes; 0 for nothing."""
    gap, side = F.abs(full - packed), F.signum((full - packed).cast("double")).cast("long")
    base = div(full, F.lit(1000))
    coarse = div(gap + div(base, F.lit(2)), F.greatest(base, F.lit(1)))
    fine = div(gap * 1000 + div(full, F.lit(2)), F.greatest(full, F.lit(1)))
    return F.when(full == 0, F.lit(0).cast("long")).otherwise(side * F.when(full > 2_000_000, coarse).otherwise(fine))


def listed_percent(milli: Column) -> Column:
    """A listing's percent of a permille, rounded to the nearest with the sign apart."""
    return F.when(milli < 0, -div(-milli + 5, F.lit(10))).otherwise(div(milli + 5, F.lit(10)))


def percent(full: Column, packed: Column) -> Column:
    """Saved percent, halves up, truncated toward zero; 0 for nothing."""
    safe = F.greatest(full, F.lit(1))
    return F.when(full == 0, F.lit(0).cast("long")).otherwise(div(div((full - packed) * 200, safe) + 1, F.lit(2)))


def change_percent(full: Column, packed: Column) -> Column:
    """Saved percent as a double, near zero counted as zero."""
    x = F.when(full == 0, F.lit(0.0)).otherwise((full - packed).cast("double") * 100 / full.cast("double"))
    return F.when(F.abs(x) < 0.5, F.lit(0.0)).otherwise(x)


def one_place(x: Column) -> Column:
    """A double to one decimal place, as its exact binary value rounds, halves to even."""
    r = F.abs(x)
    a, b = r * 16, r * 4  # both exact; their sum and what it lost are 20 r
    total = a + b
    lost = (a - (total - (total - a))) + (b - (total - a))
    k = F.floor(total / 2).cast("long")
    over = (total - (k * 2 + 1).cast("double")) + lost
    tenths = k + F.when(over > 0, 1).when(over < 0, 0).otherwise(k % 2)
    return F.concat(F.when(x < 0, "-").otherwise(""), div(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def change_text(full: Column, packed: Column) -> Column:
    """`-` smaller, `+` larger, `=` equal with the change in percent to one place; of nothing to something `?n/a`."""
    x = F.when(full == 0, F.lit(0.0)).otherwise(F.abs(packed - full).cast("double") * 100 / full.cast("double"))
    mark = F.when(packed > full, "+").when(packed < full, "-").otherwise("=")
    return F.when((full == 0) & (packed != 0), "?n/a").otherwise(F.concat(mark, one_place(x)))


def ratio_text(full: Column, packed: Column) -> Column:
    """Saved percent to one place, negative where it grew; less than 0.05 either way is 0.0%."""
    x = F.when(full == 0, F.lit(0.0)).otherwise((full - packed).cast("double") * 100 / full.cast("double"))
    return F.concat(one_place(F.when(F.abs(x) < 0.05, F.lit(0.0)).otherwise(x)), F.lit("%"))


def grouped_digits(n: Column) -> Column:
    """A whole number in groups of three digits."""
    return F.format_number(n, 0)


def checked_sum(a: Column, b: Column) -> Column:
    """The sum of two unsigned 64-bit numbers; null where it doesn't fit."""
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.when(total <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def date_argument(text: Column) -> Column:
    """`yyyy-mm-dd` or `mmddyyyy` as packed date at midnight, no earlier than 1980; null if it is neither or no month or day."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("int")
    iso, us = r"^\s*(\d{1,4})-(\d{1,2})-(\d{1,2})", r"^\s*(\d{1,2})(\d{1,2})(\d{1,4})"
    is_iso = text.rlike(iso)
    y, m, d = (F.when(is_iso, part(iso, i)).otherwise(part(us, j)) for i, j in ((1, 3), (2, 1), (3, 2)))
    packed = F.shiftleft((y - 1980).cast("long"), 25).bitwiseOR(F.shiftleft(m.cast("long"), 21)).bitwiseOR(F.shiftleft(d.cast("long"), 16))
    return F.when(m.between(1, 12) & d.between(1, 31), F.when(y < 1980, F.lit(_DOS_1980).cast("long")).otherwise(packed))


def abbreviates(word: Column, short: Column, least: int = 1, ignore_case: bool = True) -> Column:
    """Whether `short` is a beginning of the word, of so many characters at least."""
    w, s = (F.upper(word), F.upper(short)) if ignore_case else (word, short)
    return w.startswith(s) & (F.length(s) >= least)


def ntfs_times_ok(data: Column) -> Column:
    """Whether an NTFS field is four bytes and whole (tag, length, value) records, those of tag 1 with 24 bytes."""
    h, n = F.hex(data), F.octet_length(data)
    word = lambda at: F.conv(F.concat(F.substr(h, at * 2 + 3, F.lit(2)), F.substr(h, at * 2 + 1, F.lit(2))), 16, 10).cast("int")
    state = lambda at, ok: F.struct(at.cast("int").alias("at"), ok.alias("ok"))

    def step(a: Column, _: Column) -> Column:
        at = a["at"]
        bad = (word(at + 2) > n - at - 4) | ((word(at) == 1) & (word(at + 2) != 24))
        return F.when(~a["ok"] | (at >= n), a).when(n - at < 4, state(at, F.lit(False))).otherwise(state(at + 4 + word(at + 2), ~bad))

    walked = F.aggregate(F.sequence(F.lit(0), (n / 4).cast("int")), state(F.lit(4), n >= 4), step)
    return walked["ok"]


def size_text(n: Column) -> Column:
    """At most three digits and a K, M, G or T, as 9.8K; ? for the unit of what is beyond."""
    steps = F.when(n < 10240, 0)
    for k in range(1, 6):
        steps = steps.when(F.shiftright(n, 10 * k) < 10240, k)
    units, out = ["", "K", "M", "G", "T", "?", "?"], None
    for k in range(6):
        v = F.shiftright(n, 10 * k)
        tenths = F.shiftright(v * 10, 10)
        text = F.when(v >= 1000, F.concat(div(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(units[k + 1]))).otherwise(F.concat(v.cast("string"), F.lit(units[k])))
        out = F.when(steps == k, text) if out is None else out.when(steps == k, text)
    return out


def size_parse(text: Column) -> Column:
    """Digits and at most one of K, M, G, T in up to eight characters; null for anything else."""
    digits = F.regexp_extract(text, "^([0-9]+)[KMGTkmgt]?$", 1)
    unit = F.upper(F.regexp_extract(text, "([KMGTkmgt])$", 1))
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1).cast("long")
    return F.when((F.length(text) <= 8) & (digits != ""), F.expr("1L") * digits.try_cast("long") * scale)


def dos_packed(t: Column) -> Column:
    """A timestamp as packed DOS date and time, two-second steps, no earlier than 1980."""
    year = F.year(t)
    date = F.shiftleft((year - 1980).cast("long"), 25).bitwiseOR(F.shiftleft(F.month(t).cast("long"), 21)).bitwiseOR(F.shiftleft(F.dayofmonth(t).cast("long"), 16))
    time = F.shiftleft(F.hour(t).cast("long"), 11).bitwiseOR(F.shiftleft(F.minute(t).cast("long"), 5)).bitwiseOR(F.shiftright(F.second(t).cast("long"), 1))
    return F.when(year < 1980, F.lit((1 << 21) | (1 << 16)).cast("long")).otherwise(date.bitwiseOR(time))


def dos_from_unix(sec: Column, epoch: int | None = None) -> Column:
    """Unix seconds to packed time: rounded up to an even second, or with an epoch cut to it and rounded down."""
    s = F.least(sec, F.lit(epoch)) - F.least(sec, F.lit(epoch)) % 2 if epoch is not None else div(sec + 1, F.lit(2)) * 2
    return dos_packed(F.timestamp_seconds(s))


def dos_fields(packed: Column) -> dict[str, Column]:
    p = packed.cast("long")
    part = lambda by, mask: F.shiftright(p, by).bitwiseAND(mask).cast("int")
    return {"year": part(25, 127) + 1980, "month": part(21, 15), "day": part(16, 31), "hour": part(11, 31), "minute": part(5, 63), "second": part(0, 31) * 2}


def dos_timestamp(packed: Column) -> Column:
    """Null where month, day or time don't exist."""
    f = dos_fields(packed)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *(f[k] for k in ("year", "month", "day", "hour", "minute", "second")))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


_DOS_1980, _DOS_2038 = (1 << 21) | (1 << 16), (58 << 25) | (1 << 21) | (18 << 16)


def unix_from_extra(raw: Column, packed: Column) -> Column:
    """A 32-bit time by its packed companion: high bit clear unsigned, at the 1980 floor signed, from 2038 on unsigned, else the companion's."""
    dos = F.unix_timestamp(dos_timestamp(packed))
    return F.when(raw < 1 << 31, raw).when(packed == _DOS_1980, raw - (1 << 32)).when(packed >= _DOS_2038, raw).otherwise(dos)


def is_text(content: Column) -> Column:
    """None of the bytes 0-6, 14-25 and 28-31; empty content is text."""
    return ~content.rlike(r"[\x00-\x06\x0E-\x19\x1C-\x1F]")


def is_text_buffer(content: Column) -> Column:
    """The stricter test: a byte of 32 on is needed."""
    return content.rlike(r"[\x20-\x{10FFFF}]") & is_text(content)


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def byte_values(data: Column) -> Column:
    """Each byte of binary data as two hexadecimal digits."""
    return F.regexp_extract_all(F.hex(data), F.lit("(?s).."), F.lit(0))


def to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def to_crlf(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n", "\r\n")


def shown_name(name: Column) -> Column:
    """Control characters as ^A to ^_."""
    out = name
    for i in range(1, 32):
        out = F.replace(out, F.lit(chr(i)), F.lit("^" + chr(64 + i)))
    return out


def junked(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def parent(name: Column) -> Column:
    return F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", "")).otherwise("")


def safe_path(name: Column) -> Column:
    """For writing to disk: no leading slashes, `..` as `__`, no control characters."""
    out = F.regexp_replace(name, r"[\x00-\x1F\x7F]", "")
    out = F.regexp_replace(out, "(?<![^/])[.][.](?![^/])", "__")
    return F.regexp_replace(F.regexp_replace(out, "(?<![^/])[.]/", ""), "^/+", "")


def short_name(name: Column) -> Column:
    """8.3 form of a name's last component."""
    last = F.upper(F.regexp_replace(junked(name), r"[ :+,;=\[\]|<>*?\"]", ""))
    dot = F.when(last.contains("."), F.substring_index(last, ".", -1)).otherwise("")
    base = F.when(last.contains("."), F.regexp_replace(last, "[.][^.]*$", "")).otherwise(last)
    base = F.substring(F.regexp_replace(base, "[.]", "_"), 1, 8)
    return F.when(dot == "", base).otherwise(F.concat(base, F.lit("."), F.substring(dot, 1, 3)))


def escaped(text: Column) -> Column:
    """Characters outside ASCII as #Uhhhh, beyond the first plane as #Lhhhhhh."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    one = lambda c: F.when(is_ascii(c), c).when(code(c) > 0xFFFF, F.concat(F.lit("#L"), F.lower(F.lpad(F.hex(code(c)), 6, "0")))).otherwise(F.concat(F.lit("#U"), F.lower(F.lpad(F.hex(code(c)), 4, "0"))))
    return F.array_join(F.transform(chars, one), "")


def method_name(method: Column) -> Column:
    out = F.concat(F.lit("method-"), method.cast("string"))
    for number, name, _ in METHODS:
        out = F.when(method == number, name).otherwise(out)
    return out


def version_needed(method: Column) -> Column:
    out = F.lit(20)
    for number, _, version in METHODS:
        out = F.when(method == number, version).otherwise(out)
    return out


def encryption_overhead(encrypted: Column, aes_version: Column, aes_strength: Column) -> Column:
    """Bytes that encryption adds to a member: 12 for the old cipher; salt, check and tag for AES; 44 for its third form."""
    aes = F.when(aes_version == 3, 44).otherwise(aes_strength * 4 + 4 + 2 + 10)
    return F.when(~encrypted, 0).when(aes_version > 0, aes).otherwise(12).cast("long")


def le(n: Column, size: int) -> Column:
    """A number as `size` little-endian bytes."""
    h = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1))))


def from_le(data: Column, at: int, size: int) -> Column:
    h = F.hex(F.substring(data, at + 1, size))
    return F.conv(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1))), 16, 10).cast("decimal(20,0)")


def reference_checksum(method: Column, packed: Column, crc: Column, uuid: Column) -> Column:
    """CRC-32 of the 28-byte record of method, time, date, content checksum and identifier."""
    return F.crc32(F.concat(le(method, 4), le(packed.bitwiseAND(0xFFFF), 2), le(F.shiftright(packed, 16), 2), le(crc, 4), uuid))
