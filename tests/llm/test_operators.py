"""Operators against brute force on small tables, odd rows among them."""

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from archlake.llm import components, decontaminate, exact_dedup, html_extract, license_scan, minhash_dedup, packing, ragged, substring_dedup, token_counts, toxicity, url_filter

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgé") for _ in range(RNG.randint(1, 6))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, kept boolean, node long"


def say(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@lru_cache
def rows():
    base = [say(60) for _ in range(5)]
    texts = [None, "", " \n\t", "A", "a", "one two", "One  two", say(3000), *base, *base, *(f"{b} {say(3)}" for b in base), *(f"{say(20)} {b} {say(20)}" for b in base), base[0].upper(), "x" * 20_000]
    out = [(i, t, "en", "s", 0, 1, True, 2) for i, t in enumerate(texts)]
    return out + [out[9], (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact(docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(low(t), []).append(i)
    want = sorted((repr(i), max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)])) for i, t, *_ in rows())
    assert sorted((repr(r.doc_id), r.keep_id, r.group_size) for r in got) == want


def test_chunks_are_content_defined():
    a = RNG.randbytes(50_000)
    cut = lambda b: {b[x:y] for e in [[0, *exact_dedup.boundaries(b)]] for x, y in zip(e, e[1:])}
    assert b"".join(a[x:y] for e in [[0, *exact_dedup.boundaries(a)]] for x, y in zip(e, e[1:])) == a
    assert len(cut(a) & cut(b"new" + a)) > len(cut(a)) // 2


def test_near(docs):
    sets = {}
    for i, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0d]+", low(t))
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    least = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    got = minhash_dedup.near_duplicates(docs, shingle=2).where("doc_id is not null").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), least[i]) for i in ids} and len(got) == len(ids) + 1


def test_substrings(docs):
    texts = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t, *_ in rows()]
    seen = {}
    for w in texts:
        for p in range(len(w) - 34):
            seen[tuple(w[p : p + 35])] = seen.get(tuple(w[p : p + 35]), 0) + 1
    want = []
    for (i, *_), w in zip(rows(), texts):
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        want.append((repr(i), len(w), len(gone)))
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.repeated_passages(docs).collect()) == sorted(want)


def test_contamination(spark, docs):
    base = rows()[8][1].split()
    items = spark.createDataFrame([(1, " ".join(base[5:30])), (2, "one, TWO!"), (3, None), (4, ""), (5, " ".join(base[5:30])), (None, "x")], "item_id long, text string")
    w = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    want = []
    for i, t, *_ in rows():
        d, hit, n = w(t), set(), 0
        for r in items.where("item_id is not null").collect():
            x = w(r.text)
            k = min(10, len(x))
            at = [p for p in range(len(d) - k + 1) for q in range(len(x) - k + 1) if k and d[p : p + k] == x[q : q + k]]
            hit.update(p + j for p in at for j in range(k))
            n += bool(at)
        want.append((repr(i), len(d), len(hit), n))
    got = decontaminate.contamination(docs, items)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got.collect()) == sorted(want)


def test_contamination_by_items_without_id(spark, docs):
    a, b = rows()[8][1].split(), rows()[9][1].split()
    items = [(None, " ".join(a[5:30])), (None, " ".join(b[20:45])), (1, " ".join(a[25:50])), (None, "two"), (None, None)]
    w = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    want = []
    for i, t, *_ in rows():
        d, hit, ids = w(t), set(), set()
        for item, text in items:
            x = w(text)
            k = min(10, len(x))
            at = [p for p in range(len(d) - k + 1) for q in range(len(x) - k + 1) if k and d[p : p + k] == x[q : q + k]]
            hit.update(p + j for p in at for j in range(k))
            ids |= {item} if at else set()
        want.append((repr(i), len(hit), len(ids), hashlib.sha256(",".join(str(x) for x in ids if x is not None).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want) and len({x[2] for x in want}) == 3


def test_packing(docs):
    got = packing.pack(docs, F.octet_length("text"), F.md5("text"), 300, per_shard=10).collect()
    assert sum(r.length for r in got) == sum(len((t or "").encode()) for _, t, *_ in rows())
    room = {}
    for r in got:
        if r.bin_id:
            room[r.bin_id] = room.get(r.bin_id, 0) + r.length
    assert max(room.values()) <= 300


def test_best_fit_is_tightest():
    for _ in range(30):
        n = RNG.randint(1, 80)
        size = np.array(sorted((RNG.randint(1, 50) for _ in range(n)), reverse=True))
        src, cl = (np.array([RNG.randint(-1, 5) for _ in range(n)]) for _ in range(2))
        got, room, held = packing.best_fit(size, src, cl, 50, step=4), {}, {}
        for i in range(n):
            ok = [b for b in room if room[b] >= size[i] and not {("s", src[i]), ("c", cl[i])} & held[b]]
            if ok:
                assert got[i] in ok and room[got[i]] == min(room[b] for b in ok)
            else:
                assert got[i] not in room
                room[got[i]], held[got[i]] = 50, set()
            room[got[i]] -= size[i]
            held[got[i]] |= {(k, v) for k, v in (("s", src[i]), ("c", cl[i])) if v >= 0}


def test_tokens(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got) == sorted((repr(i), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows())


def test_url_aliases(spark):
    link = '<LINK href="http://{}" rel=canonical>'
    data = [
        (1, "http://A.example.org/x", link.format("b.net/y")), (2, "https://b.net/y#top", None), (3, "http://c.com/en/1", link.format("b.net/y")), (4, None, "<p>"), (5, "nothing", None),
        (6, "http://d.org/es/", '<meta http-equiv="refresh" content="0; url=/q">'), (7, "http://d.org/q", ""), (8, "http://x.example.com/en/7", link.format("e.net/z")), (9, "http://e.net/z", None), (10, "http://f.com/en/z", link.format("e.net/z")), (11, "http://e.net/z", None),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.decided_by) for r in url_filter.judge(df, url_filter.RULES).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "rule"), 4: ("allow", "default"), 5: ("allow", "default"), 6: ("block", "rule"), 7: ("block", "alias"), 8: ("allow", "rule"), 9: ("allow", "alias"), 10: ("block", "rule"), 11: ("allow", "alias")}


def test_url_aliases_in_other_forms(spark):
    tags = [
        '<link\n rel="canonical"\n href="http://b.net/y"\n>', '<meta\r\n property="og:url"\r\n content="http://b.net/y">', '<meta\n http-equiv="refresh"\n content="0; url=http://b.net/y">',
        """<meta http-equiv="refresh" content="0;URL='http://b.net/y'">""", """<meta http-equiv='refresh' content='0; url="http://b.net/y"'>""", "<meta http-equiv=refresh content=0;url=http://b.net/y>",
    ]
    data = [x for i, tag in enumerate(tags) for x in ((2 * i, f"http://a{i}.org/es/", tag.replace("b.net", f"b{i}.net")), (2 * i + 1, f"http://b{i}.net/y", None))]
    df = spark.createDataFrame([*data, (99, "http://c.net/", "<p>url='http://a0.org/es/'")], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.decided_by) for r in url_filter.judge(df, url_filter.RULES).collect()}
    assert got == {**{i: ("block", "alias" if i % 2 else "rule") for i in range(2 * len(tags))}, 99: ("allow", "default")}


def test_components(spark):
    pairs = [(RNG.randint(1, 300), RNG.randint(1, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)]
    least = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {x: c for x, c in least.items() if c != x}


def test_licenses(spark):
    t = "Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(1, "p/LICENSE", t), (2, "p/q/r.c", None), (3, "p/s.c", f"{say(80)}\nReleased under the MIT License.\n{say(80)}"), (4, "z.c", "x"), (5, None, ""), (2, "p/q/r.c", None)], "id long, path string, text string")
    got = {(r.id, r.license, r.found_in, r.from_dir) for r in license_scan.scan(df).collect()}
    assert got == {(1, "Apache-2.0", "file", None), (2, "Apache-2.0", "inherited", "p"), (3, "MIT", "header", None), (4, None, None, None), (5, None, None, None)}


def test_licenses_by_brute_force(spark):
    notices = [x for forms in license_scan.TEMPLATES.values() for x in forms]
    files = [(i, f"d{i}/a.c", f"{say(12)}\n{say(RNG.randint(0, 4))} {notices[i % len(notices)]} {say(RNG.randint(0, 4))}\n{say(12)}" if i % 3 else say(40)) for i in range(120)]
    files += [(150 + i, f"h{i}/b.c", f"{say(150)}\n{notices[i]}\n{say(150)}") for i in range(3)]
    files += [(200, "e/LICENSE", f"{notices[3]} {say(25)}"), (201, "e/f/x", "Copyright 2024 Acme. Released under the MIT License."), (202, "g/x", None), (201, "e/f/x", "Copyright 2024 Acme. Released under the MIT License.")]
    tf = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", t.lower()))
    df = Counter(t for *_, x in files for t in tf(x or ""))
    weigh = lambda c: {t: k * (math.log((len(files) + 1) / (df[t] + 1)) + 1) for t, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    forms = [(name, weigh(tf(x))) for name, xs in license_scan.TEMPLATES.items() for x in xs]

    def fits(name, own, whole):
        some, none = license_scan.DECIDES.get(name, (None, []))
        clause = "endorse or promote" in whole.lower() or re.search(r"(?i)\bBSD[ -]3", whole)
        return (some is None or own & set(some)) and not own & set(none) and (not name.startswith("BSD") or bool(clause) == (name == "BSD-3-Clause"))

    def best(texts, limit, whole):
        vs = [v for v in (weigh(tf(x)) for x in texts) if v]
        all_ = [(-round(1000 * sum(v.get(t, 0) * w for t, w in f.items()) / norm(v) / norm(f)), name) for v in vs for name, f in forms if fits(name, set(v), whole)]
        return min((x for x in all_ if -x[0] >= 1000 * limit), default=None)

    want = {}
    for i, path, x in files:
        pieces = re.split("\n", x or "") + [b for b in re.split("\n{2,}", x or "") if "\n" in b.strip("\n")]
        h, f = best(pieces, 0.7, x or ""), best([x or ""], 0.3, x or "") if path.endswith("LICENSE") else None
        want[i] = (f[1], "file", -f[0]) if f else (h[1], "header", -h[0]) if h else None
    rows = license_scan.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()
    got = {r.id: (r.license, r.found_in, r.score_permille) if r.found_in in ("file", "header") else None for r in rows}
    assert got == want and len(rows) == len(files) and len({w and w[1] for w in want.values()}) == 3 and len({w and w[0] for w in want.values()}) > 12


def test_toxicity(spark):
    bad = ["vile" + x for x in "abcdefgh"]
    texts = [(i, say(40) + (f" {RNG.choice(bad)} {say(5)}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    odd = [(1000, None), (1001, ""), (None, "vilea")]
    docs = spark.createDataFrame([x[:2] for x in texts] + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in texts], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()}
    held = [(got[i], t) for i, _, t in texts if got[i].held_out]
    assert len(held) > 40 and sum(r.predicted == t for r, t in held) >= 0.95 * len(held) and got[1000].predicted == got[1001].predicted == 0
    assert all(texts[i][1][s.start : s.end].startswith("vile") for i in range(0, 40, 4) for s in got[i].spans)


def test_blocks():
    page = "<html><script>var a='<p>no</p>'</script><nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>one<br>two <b>th</b>ree<p>four</article><!-- <p>no --><footer>f"
    assert [(t, x) for (t, _, _), x in zip(html_extract.blocks(page), html_extract.placed(html_extract.blocks(page)))] == [("Home", 0), ("T & t", 1), ("one", 1), ("two three", 1), ("four", 1), ("f", 0)]
    assert html_extract.blocks("") == [] and html_extract.blocks("<p") == [("<p", (), 0.0)]


def test_self_closing_svg():
    page = '<article><p>one <svg class="i" />two</p><svg/><p>three</p><svg><text>no</text></svg><p>four</p></article>'
    assert [t for t, *_ in html_extract.blocks(page)] == ["one", "two", "three", "four"]
    assert [t for t, *_ in html_extract.blocks('<p>a</p><svg viewBox="0 0 1 1"/><p>b')] == ["a", "b"]


def test_most_blocks(spark, monkeypatch):
    lengths, remade = [], html_extract.remade
    monkeypatch.setattr(html_extract, "remade", lambda b, y, rng: lengths.append(len(b)) or remade(b, y, rng))
    monkeypatch.setattr(html_extract.Labeller, "fit", lambda self, xs, ys: self)
    df = spark.createDataFrame([(1, "u", "<article>" + "<p>word</p>" * 2500)], "page_id long, url string, html string")
    html_extract.learn(df)
    html_extract.learn(df, most_blocks=2400)
    assert lengths == [2000, 2400]


def test_labeller(spark):
    page = lambda i: f"<html><body><nav><ul><li><a>{say(1)}</a></li></ul></nav><div class=ad>{say(6)}</div><article><h1>{say(5)}</h1><p>{say(40)}.</p></article><footer>{say(5)}</footer></body></html>"
    df = spark.createDataFrame([(i, "u", page(i)) for i in range(120)] + [(200, None, None), (201, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, html_extract.learn(df, 100)).collect()}
    want = {r.page_id: " ".join(re.findall(r"<(?:h1|p)>(.*?)</", r.html)) for r in df.where("page_id < 200").collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want) and got[200] == got[201] == ""


def test_winnowing_guarantee():
    for _ in range(30):
        h = np.array([RNG.getrandbits(60) for _ in range(40)], np.uint64)
        other = np.concatenate([np.array([RNG.getrandbits(60) for _ in range(9)], np.uint64), h[12:22]])
        a, b = (set(ragged.winnow(x, np.array([0, len(x)]), 5, 6)[1].tolist()) for x in (h, other))
        assert a & b


def test_empty_tables(spark):
    d, p = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "page_id long, url string, html string")
    lab, ben = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for out in (
        exact_dedup.exact_duplicates(d), minhash_dedup.near_duplicates(d), substring_dedup.repeated_passages(d), decontaminate.contamination(d, ben), packing.by_bytes(d), url_filter.judge(p, url_filter.RULES),
        toxicity.toxicity(d, toxicity.learn(d, lab)), html_extract.extract(p, html_extract.learn(p)), license_scan.scan(spark.createDataFrame([], "id long, path string, text string")),
    ):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert 0 < out.select("doc_id").distinct().count() < d.count() and set(out.columns) == {"doc_id", "piece", "start", "length", "bin_id"}


def one_exact(docs):
    groups = {}
    for r in docs:
        groups.setdefault(low(r[1]), []).append(r)
    return [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]


def one_near(docs):
    docs, sets = list({r[:2]: r for r in docs}.values()), []
    for _, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", low(t))
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    of[i] = min(of[i], of[j])
    return [min((docs[i] for i in range(len(docs)) if of[i] == c), key=lambda r: (r[0] is None, r[0] or 0)) for c in sorted(set(of))]


def uncontaminated(docs, items):
    w = lambda t: f" {' '.join(re.findall(r'[^\x00-\x2f\x3a-\x60\x7b-\x7f]+', low(t)))} "
    windows = [f" {' '.join(x[p : p + 10])} " for _, t in items for x in [w(t).split()] for p in range(max(1, len(x) - 9)) if x]
    return [r for r in docs if not any(x in w(r[1]) for x in windows)]


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    long_ = [say(60) for _ in range(8)]
    leak = say(20)
    texts = [
        (None, long_[0]), (None, long_[0]), (None, long_[0].upper()), (None, long_[1]), (1, long_[1]), (1, long_[1]), (2, long_[1]), (None, f"{say(5)} {leak} {say(5)}"), (None, long_[2]),
        (3, long_[3]), (3, f"{say(9)} {leak}"), (3, long_[3]), (4, long_[4]), (5, f"{long_[4]} {say(1)}"), (None, f"{long_[4]} {say(1)}"), (None, f"{long_[5]} {say(1)}"), (None, f"{long_[5]} {say(1)}"),
        (6, long_[6]), (6, f"{long_[6]} {say(1)}"), (7, None), (7, ""), (None, None), (8, long_[7]), (8, long_[7]), (None, "no words to share"),
    ]
    data = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs, items = spark.createDataFrame(data, schema).repartition(3), [(1, leak)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = lambda rows: sorted((repr(r[0]), low(r[1])) for r in rows)
    ids = lambda rows: sorted((repr(r[0]), len(r[1].encode())) for r in rows if r[1])
    got = seen(exact_dedup.stage(spark, docs, str(tmp_path)).collect())
    assert got == seen(one_exact(data))
    got, want = minhash_dedup.stage(spark, docs, str(tmp_path)).collect(), one_near(data)
    assert sorted(repr(r[0]) for r in got) == sorted(repr(r[0]) for r in want)
    assert seen(decontaminate.stage(spark, docs, str(tmp_path)).collect()) == seen(uncontaminated(data, items))
    clean = toxicity.stage(spark, docs, str(tmp_path)).collect()
    assert len(clean) > 10
    want = uncontaminated(one_near(one_exact([tuple(r) for r in clean])), items)
    packed = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed.setdefault(repr(r.doc_id), []).append(r.length)
    assert {i: (len([n for n in x if n])) for i, x in packed.items() if any(x)} == dict(Counter(i for i, _ in ids(want)))
