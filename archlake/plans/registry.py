"""Queries over member-shaped views of the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlake.functions import extras as X
from archlake.functions import glob
from archlake.functions import scalars as S
from archlake.operators import dedup, listing, notes, optimize, search, spans, split, sync, verify
from archlake.sources import codecs, crypto, extract, manifest, rewrite, ziparchive, zipwriter

from .views import FS_SQL, MEMBERS_SQL, PERMILLE_SQL, members, on_disk, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "m"):
    """Registers a query; sql goes after the views it needs: m for members, f for members and files."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + MEMBERS_SQL + ("," + FS_SQL if views == "f" else "") if views else "") + sql
        return f

    return put


def on_members(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf: f(members(spark, sf))


def on_both(f: Callable[[DataFrame, DataFrame], DataFrame]):
    def run(spark, sf):
        m = members(spark, sf)
        return f(m, on_disk(m))

    return run


def add(name: str, run, sql: str | None = None, views: str = "m") -> None:
    run.__name__ = name
    query(sql, views)(run)


_R = PERMILLE_SQL.format(u="usize", c="csize")
_NAMES = "CASE method WHEN 0 THEN 'stored' WHEN 8 THEN 'deflated' WHEN 12 THEN 'bzip2' WHEN 14 THEN 'lzma' WHEN 93 THEN 'zstd' END"
_P = f"(CASE WHEN ({_R}) < 0 THEN -((-({_R}) + 5) // 10) ELSE (({_R}) + 5) // 10 END)"
add("list_verbose", on_members(listing.verbose), f"SELECT archive, idx, usize, {_NAMES} AS method, csize, {_R} AS ratio_permille, {_P} AS ratio_percent, strftime(mtime, '%Y-%m-%d %H:%M') AS modified, name FROM members")
add("list_totals", on_members(lambda m: listing.totals(m, "archive")), f", t AS (SELECT archive, count(*) AS files, sum(usize)::BIGINT AS usize, sum(csize)::BIGINT AS csize FROM members GROUP BY archive) SELECT *, {_R} AS ratio_permille FROM t")
add("list_with_grand_total", on_members(listing.with_total), "SELECT archive, count(*) AS files, sum(usize)::BIGINT AS usize, sum(csize)::BIGINT AS csize FROM members GROUP BY ROLLUP (archive)")
add("zipinfo_medium", on_members(lambda m: listing.info(m, "m")), f"SELECT archive, name, usize, CASE method WHEN 0 THEN 'stor' WHEN 8 THEN 'defl' WHEN 12 THEN 'bzp2' WHEN 14 THEN 'lzma' ELSE 'u093' END AS code, strftime(mtime, '%y-%b-%d %H:%M') AS modified, {_P} AS percent FROM members")
add("zipinfo_long", on_members(lambda m: listing.info(m, "l")), "SELECT archive, name, usize, CASE method WHEN 0 THEN 'stor' WHEN 8 THEN 'defl' WHEN 12 THEN 'bzp2' WHEN 14 THEN 'lzma' ELSE 'u093' END AS code, strftime(mtime, '%y-%b-%d %H:%M') AS modified, csize FROM members")
add("zipinfo_names", on_members(lambda m: listing.info(m, "1")), "SELECT archive, name FROM members")
add("latest_time", on_members(lambda m: listing.latest(m, "archive").withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))), "SELECT archive, strftime(max(mtime), '%Y-%m-%d %H:%M:%S') AS latest, count(*) AS files FROM members WHERE NOT ends_with(name, '/') GROUP BY archive")
add("method_tally", on_members(listing.method_tally), "SELECT method, count(*) AS files FROM members GROUP BY method")
add("running_progress", on_members(listing.progress), "SELECT archive, idx, count(*) OVER w AS files_done, (sum(usize) OVER w)::BIGINT AS bytes_done, (sum(usize) OVER (PARTITION BY archive) - sum(usize) OVER w)::BIGINT AS bytes_left FROM members WINDOW w AS (PARTITION BY archive ORDER BY idx ROWS UNBOUNDED PRECEDING)")
add("select_ordinal", on_members(lambda m: listing.at(m, 7).select("archive", "idx", "name")), "SELECT archive, idx, name FROM members WHERE idx = 7")
add("unmatched_patterns", on_members(lambda m: listing.unmatched(m, ["*.txt", "*.zip", "src1/*", "nothing*", "src?/en/1*"])), "SELECT p AS pattern FROM (VALUES ('*.txt'), ('*.zip'), ('src1/*'), ('nothing*'), ('src?/en/1*')) t(p) WHERE NOT EXISTS (SELECT 1 FROM members WHERE name GLOB p)")

add("filter_include_exclude", on_members(lambda m: m.where(glob.name_filter(F.col("name"), include=["src1*", "*/de/*"], exclude=["*7.txt", "*/[e-f]?/*2*"])).select("name", "usize")), "SELECT name, usize FROM members WHERE (name GLOB 'src1*' OR name GLOB '*/de/*') AND NOT (name GLOB '*7.txt' OR name GLOB '*/[e-f]?/*2*')")
add("filter_recursive_tail", on_members(lambda m: m.where(glob.name_filter(F.col("name"), recurse=["1*.txt", "en/2?.txt"])).select("name")), "SELECT name FROM members WHERE string_split(name, '/')[-1] GLOB '1*.txt' OR (string_split(name, '/')[-2] || '/' || string_split(name, '/')[-1]) GLOB 'en/2?.txt'")
add("filter_stop_at_dir", on_members(lambda m: m.where(glob.matches(F.col("name"), "src1*/*/?5.TXT", ignore_case=True, stop_at_dir=True)).select("name")), "SELECT name FROM members WHERE regexp_full_match(name, '(?i)src1[^/]*/[^/]*/[^/]5[.]txt')")
add("filter_suffix", lambda s, d: table(s, d, "pages").where(glob.has_suffix(F.col("url"), ".HTML:.zip")).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)([.]html|[.]zip)$')", "")
add("filter_date_range", lambda s, d: table(s, d, "events").where(sync.between(F.col("ts"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")).select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'", "")
# Every third is empty; control characters 1 to 33 follow, but in each ninth.
_odd = lambda m: m.select("archive", "idx", F.expr("concat(if(idx % 3 = 0, '', text), if(idx % 9 = 0, '', char(idx % 33 + 1)))").alias("text"))
add("text_binary", on_members(lambda m: _odd(m).select("archive", "idx", S.is_text(F.col("text")).alias("is_text"), S.is_text_buffer(F.col("text")).alias("is_text_buffer"), S.is_ascii(F.col("text")).alias("is_ascii"))), r""", o AS (SELECT archive, idx, (CASE WHEN idx % 3 = 0 THEN '' ELSE text END) || (CASE WHEN idx % 9 = 0 THEN '' ELSE chr((idx % 33 + 1)::INT) END) AS text FROM members),
b AS (SELECT archive, idx, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT) AS bytes FROM o),
t AS (SELECT *, len(list_filter(bytes, lambda x: x <= 6 OR x BETWEEN 14 AND 25 OR x BETWEEN 28 AND 31)) = 0 AS is_text FROM b)
SELECT archive, idx, is_text, is_text AND len(list_filter(bytes, lambda x: x >= 32)) > 0 AS is_text_buffer, len(list_filter(bytes, lambda x: x > 127)) = 0 AS is_ascii FROM t""")
add("grep_modes", on_members(lambda m: m.select("idx", search.contains(F.col("text"), "The").alias("plain"), search.contains(F.col("text"), "the", True).alias("any_case"), search.contains(F.col("text"), "with", False, True).alias("word"), search.contains(F.col("text"), "With", True, True).alias("word_any_case"))), "SELECT idx, contains(text, 'The') AS plain, contains(upper(text), 'THE') AS any_case, regexp_matches(text, '(^|[^A-Za-z0-9_])with([^A-Za-z0-9_]|$)') AS word, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])with([^A-Za-z0-9_]|$)') AS word_any_case FROM members")
add("grep_lines", on_members(lambda m: search.lines(m, "[Ll]icensed under")), ", l AS (SELECT archive, name, string_split(text, chr(10)) AS ls FROM members) SELECT archive, name, i AS line_no, ls[i] AS line FROM l, unnest(range(1, len(ls) + 1)) AS t(i) WHERE regexp_matches(ls[i], '[Ll]icensed under')")
add("grep_names", on_members(lambda m: search.names(m, "[Ll]icensed under")), "SELECT DISTINCT archive, name FROM members WHERE regexp_matches(text, '[Ll]icensed under')")

_J = "SELECT archive, name, {case} AS action FROM (SELECT coalesce(m.archive, f.archive) AS archive, coalesce(m.name, f.name) AS name, m.name IS NOT NULL AS a, f.name IS NOT NULL AS d, m.mtime AS om, f.mtime + to_seconds(second(f.mtime) % 2) AS nm, m.usize AS ou, f.usize AS nu FROM members m FULL JOIN fs f ON m.archive = f.archive AND m.name = f.name) {where}"
for _name, _f, _case, _where in (
    ("sync_add", sync.add, "CASE WHEN a AND d THEN 'replace' WHEN d THEN 'add' ELSE 'copy' END", ""),
    ("sync_update", sync.update, "CASE WHEN a AND d AND nm > om THEN 'replace' WHEN a THEN 'copy' ELSE 'add' END", ""),
    ("sync_freshen", sync.freshen, "CASE WHEN d AND nm > om THEN 'replace' ELSE 'copy' END", "WHERE a"),
    ("sync_filesync", sync.filesync, "CASE WHEN a AND d AND om = nm AND ou = nu THEN 'copy' WHEN a AND d THEN 'replace' WHEN d THEN 'add' ELSE 'delete' END", ""),
    ("sync_diff", sync.difference, "CASE WHEN a THEN 'replace' ELSE 'add' END", "WHERE d AND NOT (a AND coalesce(om = nm AND ou = nu, false))"),
    ("extract_update", sync.extract, "CASE WHEN d AND om > nm THEN 'extract' WHEN d THEN 'skip' ELSE 'extract' END", "WHERE a"),
    ("extract_freshen", lambda m, f: sync.extract(m, f, "freshen"), "CASE WHEN d AND om > nm THEN 'extract' ELSE 'skip' END", "WHERE a"),
    ("extract_never", lambda m, f: sync.extract(m, f, "never"), "CASE WHEN d THEN 'skip' ELSE 'extract' END", "WHERE a"),
):
    add(_name, on_both(_f), _J.format(case=_case, where=_where), "f")
add("sync_delete", on_members(lambda m: sync.delete(m, F.col("name").startswith("src1/"), since="2024-01-10 00:00:00").select("archive", "name")), "SELECT archive, name FROM members WHERE NOT (starts_with(name, 'src1/') AND mtime >= TIMESTAMP '2024-01-10')")
add("sync_copy", on_members(lambda m: sync.copy(m, F.col("name").contains("/en/"), before="2024-02-01 00:00:00").select("archive", "name")), "SELECT archive, name FROM members WHERE contains(name, '/en/') AND mtime < TIMESTAMP '2024-02-01'")
add("dup_names", on_members(lambda m: sync.dup_names(m, S.short_name(F.regexp_replace("name", "/[^/]*$", ".txt")))), ", i AS (SELECT DISTINCT archive, name, upper(archive) || '.TXT' AS internal FROM members) SELECT archive, internal, count(*) AS inputs FROM i GROUP BY ALL HAVING count(*) > 1")

_PLAN = """
, k AS (SELECT *, coalesce(lead(off) OVER (PARTITION BY archive ORDER BY off), off + csize + 60) AS next_off FROM members),
g AS (SELECT archive, idx, usize, sha1, off, next_off - off - loclen AS gain, row_number() OVER w AS rn, first_value(idx) OVER w AS source_idx FROM k WHERE usize > 0 AND method <> 92 WINDOW w AS (PARTITION BY archive, usize, sha1 ORDER BY off)),
f AS (SELECT *, min(CASE WHEN rn > 1 AND gain > 68 THEN off END) OVER (PARTITION BY archive, usize, sha1) AS first_ok FROM g),
p AS (SELECT archive, idx, source_idx, gain - 44 AS saved FROM f WHERE rn > 1 AND off >= first_ok AND gain > 44)
"""
add("dedup_plan", on_members(dedup.plan), _PLAN + "SELECT * FROM p")
add("dedup_savings", on_members(dedup.savings), _PLAN + "SELECT archive, count(*) AS refs, count(DISTINCT source_idx) AS sources, (sum(saved) - 24 * count(DISTINCT source_idx))::BIGINT AS net_saved FROM p GROUP BY archive")


def _refs(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    u = m.withColumn("uuid", F.col("idx") % 2)
    return u.where("idx % 2 = 1").select("archive", "idx", "sha1", "uuid"), u


add("refptr_resolve", on_members(lambda m: dedup.resolve(*_refs(m))), "SELECT r.archive, r.idx, arg_min(c.idx, CASE WHEN r.idx % 2 = c.idx % 2 THEN 0 ELSE 1000000000000 END + c.off) AS source_idx FROM members r JOIN members c ON r.archive = c.archive AND r.sha1 = c.sha1 AND c.idx <> r.idx WHERE r.idx % 2 = 1 GROUP BY r.archive, r.idx")
add("refptr_guard", on_members(lambda m: dedup.broken_by(dedup.plan(m), m.where("idx % 3 = 0")).select("archive", "idx", "source_idx")), _PLAN + "SELECT archive, idx, source_idx FROM p WHERE source_idx % 3 = 0")
add("physical_next_offset", on_members(lambda m: dedup.next_offsets(m).select("archive", "idx", "off", "next_off")), "SELECT archive, idx, off, coalesce(lead(off) OVER (PARTITION BY archive ORDER BY off), off + csize + 60) AS next_off FROM members")


def _spans(m: DataFrame) -> DataFrame:
    """Members' spans, some too long or cut short."""
    return m.select("archive", "idx", F.col("off").alias("beg"), (F.col("off") + F.col("csize") + 60 + F.when(F.col("idx") % 13 == 0, 100).when(F.col("idx") % 17 == 0, -20).otherwise(0)).alias("end"))


_SP = ", s AS (SELECT archive, idx, off AS beg, off + csize + 60 + CASE WHEN idx % 13 = 0 THEN 100 WHEN idx % 17 = 0 THEN -20 ELSE 0 END AS e FROM members), b AS (SELECT *, max(e) OVER (PARTITION BY archive ORDER BY beg, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s) "
add("overlap_check", on_members(lambda m: spans.overlaps(_spans(m))), _SP + "SELECT archive, idx, beg, reached FROM b WHERE beg < reached")
add("gap_check", on_members(lambda m: spans.gaps(_spans(m))), _SP + "SELECT archive, idx, reached AS gap_beg, beg - reached AS gap_bytes FROM b WHERE beg > reached")
add("cover_merge", on_members(lambda m: spans.merged(_spans(m))), _SP + ", i AS (SELECT *, sum(CASE WHEN beg <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY archive ORDER BY beg, e ROWS UNBOUNDED PRECEDING) AS n FROM b) SELECT archive, min(beg) AS beg, max(e) AS \"end\" FROM i GROUP BY archive, n")
add("cover_within", on_members(lambda m: spans.within(m.select("archive", (F.col("idx") * 997).alias("at")), spans.merged(_spans(m)))), _SP + "SELECT archive, p AS at FROM (SELECT archive, idx * 997 AS p FROM members) q WHERE EXISTS (SELECT 1 FROM s WHERE s.archive = q.archive AND beg <= p AND p < e)")

_CAP = 200_000
_weighed = lambda m: m.select("archive", "idx", split.weight(F.length("name"), F.col("csize")).cast("long").alias("weight"))
_SEQ = f""", w AS (SELECT archive, idx, 84 + 2 * length(name) + csize AS weight, row_number() OVER (PARTITION BY archive ORDER BY idx) AS n FROM members),
r AS (SELECT archive, idx, n, 0 AS bin, weight AS used FROM w WHERE n = 1),
f AS (WITH RECURSIVE q(archive, idx, n, bin, used) AS (SELECT * FROM r UNION ALL SELECT w.archive, w.idx, w.n, q.bin + CASE WHEN q.used + w.weight > {_CAP} THEN 1 ELSE 0 END, CASE WHEN q.used + w.weight > {_CAP} THEN w.weight ELSE q.used + w.weight END FROM q JOIN w ON w.archive = q.archive AND w.n = q.n + 1) SELECT * FROM q) """
add("split_sequential", on_members(lambda m: split.sequential(_weighed(m), _CAP)), _SEQ + "SELECT archive, idx, bin FROM f")
add("split_greedy", on_members(lambda m: split.greedy(_weighed(m), _CAP)))
add("split_assigned", on_members(lambda m: split.assigned(_weighed(m), _CAP)))
add("split_efficiency", on_members(lambda m: split.efficiency(_weighed(m), split.sequential(_weighed(m), _CAP), _CAP)), _SEQ + f"SELECT f.archive, max(bin)::BIGINT + 1 AS parts, (100 * ((any_value(t) + {_CAP - 1}) // {_CAP}))::BIGINT // (max(bin) + 1) AS efficiency FROM f JOIN (SELECT archive, sum(weight)::BIGINT AS t FROM w GROUP BY archive) USING (archive) GROUP BY f.archive")

add("owner_companion_check", lambda s, d: verify.owners(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("owner").alias("role"), (F.col("o_orderkey") % 2 + 1).alias("mode")).unionByName(table(s, d, "lineitem").where("l_linenumber <= 2 and l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("id"), F.lit("companion").alias("role"), F.lit(None).cast("long").alias("mode")))), "WITH i AS (SELECT o_orderkey AS id, 1 AS o, 0 AS c, o_orderkey % 2 + 1 AS mode FROM orders UNION ALL SELECT l_orderkey, 0, 1, NULL FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 5 <> 0), g AS (SELECT id, sum(o)::BIGINT AS owners, sum(c)::BIGINT AS companions, max(mode) AS mode FROM i GROUP BY id) SELECT * FROM g WHERE coalesce(owners <> 1 OR companions <> CASE WHEN mode = 2 THEN 1 ELSE 0 END, true)", "")
add("header_mismatch", on_members(lambda m: verify.headers(m, m.select("archive", "idx", "method", (F.col("csize") + F.when(F.col("idx") % 19 == 0, 1).otherwise(0)).alias("csize"), F.when(F.col("idx") % 23 == 0, None).otherwise(F.col("usize")).alias("usize")), ("method", "csize", "usize"))), "SELECT archive, idx, 'header' AS \"check\", 2 AS severity, CASE WHEN idx % 19 = 0 AND idx % 23 = 0 THEN 'csize,usize' WHEN idx % 19 = 0 THEN 'csize' ELSE 'usize' END AS detail FROM members WHERE idx % 19 = 0 OR idx % 23 = 0")
add("verify_equal", on_members(lambda m: verify.equal(m.select("name", "sha1"), m.select("name", F.when(F.col("idx") % 29 == 0, F.lit("x")).otherwise(F.col("sha1")).alias("sha1")))), "SELECT name, sha1, 'left' AS side FROM members WHERE idx % 29 = 0 UNION ALL SELECT name, 'x', 'right' FROM members WHERE idx % 29 = 0")
add("archive_status_severity", on_members(lambda m: verify.summary(m.where("idx % 19 = 0").select("archive", (F.col("idx") % 3).cast("int").alias("severity")), m.select("archive").distinct())), "SELECT archive, count(*) FILTER (idx % 19 = 0) AS findings, coalesce(max(CASE WHEN idx % 19 = 0 THEN idx % 3 END), 0)::INT AS severity FROM members GROUP BY archive")
add("checksums", on_members(lambda m: m.select("idx", F.md5("text").alias("md5"), "sha1", F.sha2("text", 256).alias("sha256"))), "SELECT idx, md5(text) AS md5, sha1, sha256(text) AS sha256 FROM members")
add("crc32_members", on_members(lambda m: m.select("idx", F.crc32("text").alias("crc"))))
add("byte_histogram", on_members(lambda m: m.select("archive", F.explode(S.byte_values(F.encode("text", "UTF-8"))).alias("byte")).groupBy("archive", "byte").agg(F.count("*").alias("n"))), "SELECT archive, byte, count(*) AS n FROM (SELECT archive, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM members) GROUP BY ALL")
add("percent_all", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.percent(F.col("l_partkey"), F.col("l_suppkey") * 7).alias("percent"), S.permille(F.col("l_partkey") * 2000, F.col("l_suppkey") * 9000).alias("permille")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey = 0 THEN 0 ELSE ((200 * (l_partkey - l_suppkey * 7)) // greatest(l_partkey, 1) + 1) // 2 END AS percent, " + PERMILLE_SQL.format(u="(l_partkey * 2000)", c="(l_suppkey * 9000)") + " AS permille FROM lineitem", "")
add("size_format", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.size_text(F.col("l_partkey") * F.col("l_suppkey") * F.col("l_orderkey")).alias("text"), S.size_parse(F.concat(F.col("l_partkey").cast("string"), F.element_at(F.array(*map(F.lit, ["", "K", "m", "x"])), (F.col("l_linenumber") % 4 + 1).cast("int")))).alias("parsed")),
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * l_suppkey * l_orderkey AS n FROM lineitem), k AS (SELECT *, CASE WHEN n < 10240 THEN 0 WHEN n >> 10 < 10240 THEN 1 WHEN n >> 20 < 10240 THEN 2 ELSE 3 END AS s FROM x), v AS (SELECT *, n >> (10 * s) AS v FROM k) SELECT l_orderkey, l_linenumber, CASE WHEN v >= 1000 THEN (((v * 10) >> 10) // 10)::VARCHAR || '.' || (((v * 10) >> 10) % 10)::VARCHAR || ['', 'K', 'M', 'G', 'T'][s + 2] ELSE v::VARCHAR || ['', 'K', 'M', 'G', 'T'][s + 1] END AS text, CASE l_linenumber % 4 WHEN 0 THEN l_partkey WHEN 1 THEN l_partkey * 1024 WHEN 2 THEN l_partkey * 1048576 END AS parsed FROM v", "")
add("dos_time_roundtrip", lambda s, d: table(s, d, "events").select("event_id", S.dos_packed(F.col("ts")).alias("packed"), F.date_format(S.dos_timestamp(S.dos_packed(F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("back"), S.dos_from_unix(F.unix_timestamp("ts")).alias("rounded_up")),
    "WITH x AS (SELECT event_id, ts, to_timestamp(((epoch(date_trunc('second', ts))::BIGINT + 1) // 2) * 2)::TIMESTAMP AS up FROM events) SELECT event_id, ((year(ts) - 1980) << 25) | (month(ts) << 21) | (day(ts) << 16) | (hour(ts) << 11) | (minute(ts) << 5) | (second(ts) >> 1) AS packed, strftime(date_trunc('second', ts) - to_seconds(second(ts) % 2), '%Y-%m-%d %H:%M:%S') AS back, ((year(up) - 1980) << 25) | (month(up) << 21) | (day(up) << 16) | (hour(up) << 11) | (minute(up) << 5) | (second(up) >> 1) AS rounded_up FROM x", "")
add("name_parts", on_members(lambda m: m.select("idx", S.junked(F.col("name")).alias("last"), S.parent(F.col("name")).alias("parent"), S.safe_path(F.concat(F.lit("/../"), "name")).alias("safe"), S.shown_name(F.concat("archive", F.lit("\t"))).alias("shown"))), "SELECT idx, string_split(name, '/')[-1] AS last, regexp_replace(name, '/[^/]*$', '') AS parent, '__/' || name AS safe, archive || '^I' AS shown FROM members")
add("line_endings", on_members(lambda m: m.select("idx", F.md5(S.to_crlf(F.col("text"))).alias("crlf"), F.md5(S.to_lf(S.to_crlf(F.col("text")))).alias("lf"))), "SELECT idx, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) AS crlf, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS lf FROM members")
add("sorted_names", on_members(lambda m: m.select("archive", "name", F.row_number().over(Window.partitionBy("archive").orderBy(F.encode("name", "UTF-8"))).cast("long").alias("place"))), "SELECT archive, name, row_number() OVER (PARTITION BY archive ORDER BY encode(name)) AS place FROM members")


def _fields(m: DataFrame) -> DataFrame:
    f = lambda tag, c: F.struct(F.lit(tag).alias("tag"), F.encode(c, "UTF-8").alias("data"))
    return m.select("idx", F.array(f(1, F.col("archive")), f(0x4B46, F.col("sha1")), f(1, F.col("name"))).alias("x"))


add("extras_explode", on_members(lambda m: _fields(m).select("idx", F.posexplode("x").alias("place", "e")).select("idx", "place", "e.tag", F.decode("e.data", "UTF-8").alias("data"))), "SELECT idx, 0 AS place, 1 AS tag, archive AS data FROM members UNION ALL SELECT idx, 1, 19270, sha1 FROM members UNION ALL SELECT idx, 2, 1, name FROM members")
add("extras_lookup", on_members(lambda m: _fields(m).select("idx", F.decode(X.lookup(F.col("x"), 1), "UTF-8").alias("first"), F.decode(X.last(F.col("x"), 1), "UTF-8").alias("last"), X.has_duplicates(F.col("x")).alias("doubled"), F.size(X.without(F.col("x"), 1)).alias("left"))), "SELECT idx, archive AS first, name AS last, true AS doubled, 1 AS \"left\" FROM members")

add("layout_findings", on_members(lambda m: verify.layout(_spans(m))), _SP + "SELECT archive, idx, 'overlap' AS \"check\", 3 AS severity, (reached - beg)::BIGINT::VARCHAR AS detail FROM b WHERE beg < reached UNION ALL SELECT archive, idx, 'gap', 1, (beg - reached)::BIGINT::VARCHAR FROM b WHERE beg > reached")
_tagged = lambda m: m.select("archive", "idx", F.expr(f"cast(transform(element_at(array(array(1, 23), array(1, 9, 26), array(1, 1)), cast(idx % 3 as int) + 1), t -> struct(t as tag, cast('' as binary) as data)) as {X.TYPE})").alias("extras"))
add("field_findings", on_members(lambda m: verify.fields(_tagged(m), (1, 23))), "SELECT archive, idx, 'field' AS \"check\", 2 AS severity, CASE idx % 3 WHEN 1 THEN '9,1A' ELSE 'repeated' END AS detail FROM members WHERE idx % 3 <> 0")


def _cataloged(m: DataFrame) -> DataFrame:
    """Members with attributes, flags and systems by rule, as a catalog has them."""
    cols = {
        "host": "element_at(array(0, 3, 11, 30, 25), cast(idx % 5 as int) + 1)", "version_made": "cast(20 + idx % 45 as int)", "external_attr": "shiftleft(idx * 7919 % 65536, 16) + idx % 64", "internal_attr": "cast(idx % 2 as int)",
        "flags": "cast(idx % 16 as int)", "encrypted": "idx % 2 = 1", "aes_version": "0", "aes_strength": "0", "real_method": "method", "extras": f"if(idx % 3 = 0, array(named_struct('tag', 1, 'data', cast('' as binary))), cast(array() as {X.TYPE}))",
        "name": "concat(name, if(idx % 7 = 0, '.Exe', ''))", "crc": "crc32(text)",
    }
    return m.withColumns({c: F.expr(e) for c, e in cols.items()})


_BIT = "CASE WHEN x & {b} <> 0 THEN '{y}' ELSE '{n}' END"
_UNIX = "CASE x >> 12 WHEN 4 THEN 'd' WHEN 8 THEN '-' WHEN 10 THEN 'l' WHEN 6 THEN 'b' WHEN 2 THEN 'c' WHEN 1 THEN 'p' WHEN 12 THEN 's' ELSE '?' END" + "".join(
    f" || {_BIT.format(b=r, y='r', n='-')} || {_BIT.format(b=r // 2, y='w', n='-')} || CASE WHEN x & {s} <> 0 THEN {_BIT.format(b=r // 4, y=c, n=c.upper())} ELSE {_BIT.format(b=r // 4, y='x', n='-')} END" for r, s, c in ((256, 2048, "s"), (32, 1024, "s"), (4, 512, "t"))
)
_SIZE = "CASE WHEN idx % 2 = 1 AND csize >= 12 THEN csize - 12 ELSE csize END"
_RE = PERMILLE_SQL.format(u="usize", c=f"({_SIZE})")
add("zipinfo_columns", on_members(lambda m: listing.columns(_cataloged(m))), f""", c AS (SELECT *, (idx * 7919) % 65536 AS x, idx % 64 AS low, [0, 3, 11, 30, 25][idx % 5 + 1] AS h, name || CASE WHEN idx % 7 = 0 THEN '.Exe' ELSE '' END AS n, {_RE} AS r FROM members),
d AS (SELECT *, h IN (0, 11) AND (h <> 0 OR x & 448 <> 256 + CASE WHEN low & 1 = 0 THEN 128 ELSE 0 END + CASE WHEN low & 16 <> 0 THEN 64 ELSE 0 END) AS dos FROM c)
SELECT archive, n AS name, CASE WHEN dos THEN CASE WHEN low & 24 = 8 THEN 'V' WHEN low & 16 <> 0 THEN 'd' ELSE '-' END || 'r' || CASE WHEN low & 1 <> 0 THEN '-' ELSE 'w' END || CASE WHEN low & 16 <> 0 OR (low & 24 <> 8 AND idx % 7 = 0) THEN 'x' ELSE '-' END || CASE WHEN low & 32 <> 0 THEN 'a' ELSE '-' END || CASE WHEN low & 2 <> 0 THEN 'h' ELSE '-' END || CASE WHEN low & 4 <> 0 THEN 's' ELSE '-' END ELSE {_UNIX} END AS mode,
       ((20 + idx % 45) // 10)::VARCHAR || '.' || ((20 + idx % 45) % 10)::VARCHAR AS version, CASE h WHEN 0 THEN 'fat' WHEN 3 THEN 'unx' WHEN 11 THEN 'ntf' WHEN 30 THEN 'ath' ELSE '???' END AS host, usize, csize, CASE WHEN idx % 2 = 1 THEN 'T' ELSE 'b' END AS kind,
       CASE WHEN idx % 3 = 0 THEN CASE WHEN idx & 8 <> 0 THEN 'X' ELSE 'x' END WHEN idx & 8 <> 0 THEN 'l' ELSE '-' END AS fields, CASE WHEN r < 0 THEN -((-r + 5) // 10) ELSE (r + 5) // 10 END AS percent,
       CASE method WHEN 0 THEN 'stor' WHEN 8 THEN 'def' || ['N', 'X', 'F', 'S'][(idx >> 1) % 4 + 1] WHEN 12 THEN 'bzp2' WHEN 14 THEN 'lzma' ELSE 'zstd' END AS code FROM d""")
add("list_encrypted", on_members(lambda m: listing.verbose(_cataloged(m).withColumn("crc", (F.col("idx") * 65537) % 2**32)).select("archive", "idx", "csize", "ratio_permille", "crc")), f"SELECT archive, idx, {_SIZE} AS csize, {_RE} AS ratio_permille, printf('%08x', (idx * 65537) % 4294967296) AS crc FROM members")

_sig = lambda m: m.select("archive", "idx", F.col("text").alias("raw"), X.append(F.array().cast(X.TYPE), 0x4B46, F.concat(F.lit("MD5").cast("binary"), F.unhex(F.md5(F.concat("text", F.expr("if(idx % 17 = 0, 'x', '')")))))).alias("extras"))
add("fwkcs_verify", on_members(lambda m: verify.signatures(_sig(m))), "SELECT archive, idx, 'signature' AS \"check\", 2 AS severity, md5(text || 'x') AS detail FROM members WHERE idx % 17 = 0")
_time = lambda: F.concat(F.unhex(F.lpad(F.hex(F.col("idx") % 4), 2, "0")), S.le(F.col("idx") * 1000, 4))
add("entry_times", on_members(lambda m: m.select("idx", X.entry_time(X.append(F.array().cast(X.TYPE), 0x5455, _time())).alias("mtime"))), "SELECT idx, CASE WHEN idx % 2 = 1 THEN idx * 1000 END AS mtime FROM members")
add("extras_union", on_members(lambda m: _fields(m).select("idx", X.merged(F.col("x"), X.append(F.array().cast(X.TYPE), 1, F.encode(F.lit("n"), "UTF-8"))).alias("y"), "x").select("idx", F.size("y").alias("fields"), F.decode(X.lookup(F.col("y"), 1), "UTF-8").alias("first"), X.ascending(F.col("y")).alias("ascending"), X.ascending(F.col("x")).alias("was_ascending"), F.size(F.map_keys(X.as_map(F.col("y")))).alias("tags"), X.as_map(F.col("x")).isNull().alias("doubled"))), "SELECT idx, 2 AS fields, 'n' AS first, true AS ascending, false AS was_ascending, 2 AS tags, true AS doubled FROM members")
_ntfs = lambda: F.concat(F.unhex(F.lit("00000000")), F.when(F.col("idx") % 3 == 0, F.unhex(F.lit("02000000"))).otherwise(F.unhex(F.lit(""))), S.le(F.lit(1), 2), S.le(F.when(F.col("idx") % 5 == 0, 20).otherwise(24), 2), F.unhex(F.repeat(F.lit("00"), F.when(F.col("idx") % 7 == 0, 23).otherwise(24))))
add("ntfs_valid", on_members(lambda m: m.select("idx", S.ntfs_times_ok(_ntfs()).alias("ok"), S.ntfs_times_ok(F.unhex(F.lit("000000"))).alias("short"))), "SELECT idx, idx % 5 <> 0 AND idx % 7 <> 0 AS ok, false AS short FROM members")
add("sizes_encrypted", on_members(lambda m: m.select("idx", S.encryption_overhead(F.col("idx") % 2 == 1, (F.col("idx") % 4).cast("int"), (F.col("idx") % 3 + 1).cast("int")).alias("overhead"), S.version_needed(F.col("method")).alias("version"), S.from_le(S.le(F.col("usize"), 8), 0, 8).cast("long").alias("u64"), S.from_le(S.le(F.col("usize") % 60000, 2), 0, 2).cast("long").alias("u16"))), "SELECT idx, CASE WHEN idx % 2 = 0 THEN 0 WHEN idx % 4 = 3 THEN 44 ELSE (idx % 3 + 1) * 4 + 16 END AS overhead, CASE method WHEN 0 THEN 10 WHEN 8 THEN 20 WHEN 12 THEN 46 ELSE 63 END AS version, usize AS u64, usize % 60000 AS u16 FROM members")
_U, _C = "l_partkey * 100", "l_suppkey * 1000 + l_linenumber"
add("ratio_texts", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.grouped_digits(F.expr(_U)).alias("digits"), S.ratio_text(F.expr(_U), F.expr(_C)).alias("ratio"), S.change_text(F.expr(_U), F.expr(_C)).alias("change"), F.round(S.change_percent(F.expr(_U), F.expr(_C)), 6).alias("percent")), f"SELECT l_orderkey, l_linenumber, format('{{:,}}', {_U}) AS digits, printf('%.1f%%', CASE WHEN abs(r) < 0.05 THEN 0.0 ELSE r END) AS ratio, CASE WHEN {_U} = 0 AND {_C} <> 0 THEN '?n/a' ELSE (CASE WHEN {_C} > {_U} THEN '+' WHEN {_C} < {_U} THEN '-' ELSE '=' END) || printf('%.1f', abs(r)) END AS change, round(CASE WHEN abs(r) < 0.5 THEN 0.0 ELSE r END, 6) AS percent FROM (SELECT *, CASE WHEN {_U} = 0 THEN 0.0 ELSE ({_U} - ({_C}))::DOUBLE * 100 / ({_U})::DOUBLE END AS r FROM lineitem)", "")
add("sum_checked", lambda s, d: table(s, d, "orders").select("o_orderkey", S.checked_sum(F.lit(str(2**64 - 40_000)).cast("decimal(20,0)"), F.col("o_orderkey")).cast("string").alias("total")), "SELECT o_orderkey, CASE WHEN o_orderkey < 40000 THEN (18446744073709511616::HUGEINT + o_orderkey)::VARCHAR END AS total FROM orders", "")
add("date_arguments", lambda s, d: table(s, d, "orders").select("o_orderkey", S.date_argument(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"), S.date_argument(F.date_format("o_orderdate", "MMddyyyy")).alias("us"), S.date_argument(F.lit("1970-02-03")).alias("early"), S.date_argument(F.lit("2020-13-01")).alias("wrong")), "SELECT o_orderkey, p AS iso, p AS us, 2162688::BIGINT AS early, NULL::BIGINT AS wrong FROM (SELECT o_orderkey, ((year(o_orderdate) - 1980) << 25) + (month(o_orderdate) << 21) + (day(o_orderdate) << 16) AS p FROM orders)", "")
add("option_abbreviations", lambda s, d: table(s, d, "part").select("p_partkey", S.abbreviates(F.lit("filesync"), F.substring(F.lit("FileSynchron"), 1, 1 + F.col("p_partkey").cast("int") % 12), 4).alias("any_case"), S.abbreviates(F.lit("filesync"), F.substring(F.lit("FileSync"), 1, 4), 2, False).alias("same_case")), "SELECT p_partkey, p_partkey % 12 BETWEEN 3 AND 7 AS any_case, false AS same_case FROM part", "")
_PATTERN = "concat(element_at(array('a', 'b\\\\*', 'c?', '[d', 'e]', '\\\\', 'f\\\\[g*'), cast(idx % 7 as int) + 1), '/', name)"
add("wildcards", on_members(lambda m: m.select("idx", glob.wildcard_at(F.expr(_PATTERN)).alias("at"), glob.is_wild(F.expr(_PATTERN)).alias("wild"), glob.has_metachar(F.expr(_PATTERN)).alias("meta"))), "SELECT idx, [0, 0, 2, 1, 0, 0, 5][idx % 7 + 1] AS at, idx % 7 IN (2, 3, 6) AS wild, idx % 7 <> 0 AS meta FROM members")
add("deepest_first", on_members(lambda m: m.select("archive", "name", F.row_number().over(Window.partitionBy("archive").orderBy(F.encode("name", "UTF-8").desc())).alias("place"))), "SELECT archive, name, row_number() OVER (PARTITION BY archive ORDER BY encode(name) DESC)::INT AS place FROM members")
add("pairs_in_order", lambda s, d: verify.paired(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("owner").alias("role")).unionByName(table(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.lit("companion").alias("role")))), "SELECT id, role, row_number() OVER (PARTITION BY id ORDER BY role = 'owner')::INT AS place FROM (SELECT o_orderkey AS id, 'owner' AS role FROM orders UNION ALL SELECT l_orderkey, 'companion' FROM lineitem WHERE l_linenumber = 1)", "")


def _sizes(m: DataFrame) -> DataFrame:
    """Sizes of three candidates by rule, so that the choice can be checked in SQL."""
    c = F.array(*[F.struct(F.lit(i).alias("code"), F.lit(n).alias("method"), F.expr(f"usize - (usize * ((idx * {k}) % 11)) div 20").alias("csize")) for i, (n, k) in enumerate([(8, 3), (12, 5), (93, 7)])])
    return m.select("archive", "idx", F.explode(c).alias("c")).select("archive", "idx", "c.*")


add("best_candidate", on_members(lambda m: optimize.ranked(m, _sizes(m), optimize.selected("all,-lzma"))), """
, c AS (SELECT archive, idx, -1 AS code, method, csize FROM members WHERE method <> 14
        UNION ALL SELECT archive, idx, i, [8, 12, 93][i + 1], usize - (usize * ((idx * [3, 5, 7][i + 1]) % 11)) // 20 FROM members, unnest([0, 1, 2]) AS t(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY archive, idx ORDER BY csize, code) AS rn FROM c)
SELECT archive, idx, method AS best_method, csize AS best_csize, code < 0 AS kept_original FROM r WHERE rn = 1""")
# Packed sizes are the codecs' own business; SQL knows which there are and that each gives the bytes back.
add("codec_sizes", on_members(lambda m: optimize.encode_all(m.select("archive", "idx", F.encode("text", "UTF-8").alias("data"))).select("archive", "idx", "code", "method", (F.col("csize") > 0).alias("packed"), "ok")), "SELECT archive, idx, i::INT AS code, [0, 8, 12, 14, 93, 95][i + 1] AS method, i > 0 OR usize > 0 AS packed, true AS ok FROM members, unnest(range(0, 6)) AS t(i)")
add("deflate_roundtrip", on_members(lambda m: m.select("idx", (codecs.decoded(F.lit(8), codecs.encoded(F.lit(8), F.encode("text", "UTF-8"))) == F.encode("text", "UTF-8")).alias("same"))), "SELECT idx, true AS same FROM members")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    files = m.select("archive", "name", F.encode("text", "UTF-8").alias("content"), "mtime")
    return zipwriter.archives(zipwriter.packed(files)).withColumnRenamed("archive", "path")


add("zip_scan", lambda s, d: ziparchive.tables_of(_archives(s, d), "members", "FAILFAST").select("archive", "name", "usize", F.date_format(S.dos_timestamp(F.col("dos_datetime")), "yyyy-MM-dd HH:mm:ss").alias("mtime")), "SELECT archive, name, usize, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM members")
add("zip_salvage", lambda s, d: ziparchive.tables_of(_archives(s, d), "members", "SALVAGE").select("archive", "name", "usize"), "SELECT archive, name, usize FROM members")
add("zip_archives", lambda s, d: ziparchive.tables_of(_archives(s, d), "archives").select("archive", "entry_count", "status"), "SELECT archive, count(*) AS entry_count, 'ok' AS status FROM members GROUP BY archive")
add("zip_contents", lambda s, d: ziparchive.tables_of(_archives(s, d), "payloads").select("archive", "name", F.sha1(codecs.decoded(F.col("method"), F.col("payload"))).alias("sha1")), "SELECT archive, name, sha1 FROM members")
# Of each seventh member the sum is changed, of each eleventh the length, of each thirteenth the method.
_damaged = lambda p: p.withColumn("n", F.regexp_extract("name", r"(\d+)[.]txt$", 1).cast("long")).withColumn("crc", F.expr("if(n % 7 = 0, crc + 1, crc)")).withColumn("usize", F.expr("if(n % 11 = 0, usize + 1, usize)")).withColumn("method", F.expr("if(n % 13 = 0, 77, method)"))
add("zip_test", lambda s, d: verify.contents(_damaged(ziparchive.tables_of(_archives(s, d), "payloads"))).groupBy("archive", "check", "severity", "detail").agg(F.count("*").alias("n")), "SELECT archive, 'content' AS \"check\", 3 AS severity, CASE WHEN idx % 13 = 0 THEN 'not decoded' WHEN idx % 11 = 0 THEN 'length' ELSE 'checksum' END AS detail, count(*) AS n FROM members WHERE idx % 7 = 0 OR idx % 11 = 0 OR idx % 13 = 0 GROUP BY ALL")


def _rewritten(how, back=lambda e: e, volume_size: int | None = None, arranged: bool = True):
    """Contents' digests of archives after a rewrite, each text twice so that there are duplicates. arranged: the rewrite leaves entries where they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = members(spark, sf_dir)
        files = m.select("archive", F.explode(F.array("name", F.concat(F.lit("copy/"), "name"))).alias("name"), F.encode("text", "UTF-8").alias("content"), "mtime")
        first = rewrite.reread(zipwriter.packed(files, numbered=False))
        e = back(rewrite.reread(how(first), volume_size=volume_size, arranged=arranged))
        return e.select(F.regexp_replace("archive", "[.]zip$", "").alias("archive"), "name", F.sha1(codecs.decoded(F.col("method"), F.col("payload"), F.col("flags"), F.col("usize"))).alias("sha1"))

    return run


_TWICE = "SELECT archive, p || name AS name, sha1 FROM members, (VALUES (''), ('copy/')) AS v(p)"
add("zip_copied", _rewritten(rewrite.copied), _TWICE)
add("zip_recompressed", _rewritten(lambda e: rewrite.optimized(e, "store,deflate,zstd")), _TWICE)
add("zip_references", _rewritten(rewrite.deduplicated, rewrite.expanded, arranged=False), _TWICE)
add("zip_volumes", _rewritten(lambda e: rewrite.copied(e).withColumn("archive", F.concat("archive", F.lit(".zip"))), volume_size=1 << 16), _TWICE)
add("zip_extracted", lambda s, d: extract.files(ziparchive.tables_of(_archives(s, d), "payloads")).select("archive", "target", F.sha1("content").alias("sha1")), "SELECT archive, name AS target, sha1 FROM members")


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives under a password, their members' bytes opened with it."""
    m = members(spark, sf_dir)
    files = m.select("archive", "name", F.encode("text", "UTF-8").alias("content"), "mtime")
    sealed = crypto.encrypted(zipwriter.packed(files, numbered=False), b"archive")
    # Keys take a thousand rounds a member: they are made before rows are dealt out by archive, and after they are dealt out evenly.
    return crypto.decrypted(rewrite.reread(sealed, "payloads").repartition("archive", "idx"), b"archive")


add("zip_encrypted_contents", lambda s, d: _sealed(s, d).select("archive", "name", F.sha1(codecs.decoded(F.col("method"), F.col("payload"))).alias("sha1")), "SELECT archive, name, sha1 FROM members")
add("shrink_roundtrip", on_members(lambda m: m.select("idx", (codecs.decoded(F.lit(1), codecs.encoded(F.lit(1), F.encode("text", "UTF-8"))) == F.encode("text", "UTF-8")).alias("same"))), "SELECT idx, true AS same FROM members")


def _attributed(m: DataFrame) -> DataFrame:
    """Two attributes of each member, through manifests in its field and back."""
    told = F.struct(F.lit(1).alias("tag"), F.lit(0).alias("flags"), F.lit(b"\1\0").alias("data"))
    pair = lambda name, value: F.struct(F.encode(F.lit(name), "UTF-8").alias("name"), F.encode(value, "UTF-8").alias("value"))
    rows = m.select("archive", "idx", F.md5(F.col("idx").cast("string")).alias("owner_id"), F.explode(F.array(pair("sha1", F.col("sha1")), pair("lang", F.col("archive")))).alias("x"))
    one = F.lit(1)
    rows = rows.select("archive", "idx", "owner_id", one.alias("type"), F.lit(0).alias("flags"), one.alias("origin"), F.lit(0).alias("encoding"), F.lit(b"user").alias("namespace"), "x.name", F.array(told).alias("tlvs"), "x.value")
    held = manifest.encoded(rows).select("archive", "idx", F.array(F.struct(F.lit(manifest.TAG).alias("tag"), F.col("field").alias("data"))).alias("extras"))
    inline = manifest.owner_fields(held).withColumn("manifest", F.col("body"))
    return manifest.attributes(inline, "FAILFAST").select("archive", "idx", "owner_id", "place", F.decode("name", "UTF-8").alias("name"), F.decode("value", "UTF-8").alias("value"))


add("manifest_attributes", on_members(_attributed), "SELECT archive, idx, md5(idx::VARCHAR) AS owner_id, 0 AS place, 'lang' AS name, archive AS value FROM members UNION ALL SELECT archive, idx, md5(idx::VARCHAR), 1, 'sha1', sha1 FROM members")


def _commented(m: DataFrame) -> DataFrame:
    return m.select("archive", "idx", "name", F.concat(F.lit("@ "), F.col("idx").cast("string"), F.lit(" \\ note\nline two")).alias("comment"))


add("notes_roundtrip", on_members(lambda m: notes.edits(notes.dumped(_commented(m))).select("archive", "name", "comment")), "SELECT archive, name, '@ ' || idx::VARCHAR || ' \\ note' || chr(10) || 'line two' AS comment FROM members")
