"""Long, malformed and regular input, and rows whose columns clash."""

import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from archlake.llm import decontaminate, exact_dedup, html_extract, license_scan, minhash_dedup, packing, ragged, substring_dedup, tables, token_counts, toxicity, url_filter

RNG = random.Random(11)


def regular(n: int, a: str = "a", b: str = "b") -> str:
    """Thue and Morse's word: polynomials modulo 2**64 take it and its complement for one from 1,024 letters on."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def hashes(*words: str) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ws, we, _ = ragged.words(data, np.array([0, len(data)]), ragged.SPACES)
    return ragged.word_hashes(data, ws, we)


def test_regular_words_have_hashes_of_their_own():
    for n in (16, 32, 64, 256, 1024, 2048):
        a, b = hashes(regular(n), regular(n, "b", "a"))
        assert a != b


def test_numbers_of_grams_are_exact():
    for k in (1, 2, 3, 5, 8, 35):
        x = np.array([RNG.randint(0, 1) for _ in range(300)])
        of = {}
        for i, g in enumerate(ragged.gram_ids(x, k).tolist()):
            assert of.setdefault(tuple(x[i : i + k].tolist()), g) == g
        assert len(set(of.values())) == len(of) and len(ragged.gram_ids(x[:1], 2)) == 0


def test_near_duplicates_of_regular_words(spark):
    a, b = regular(1024), regular(1024, "b", "a")
    docs = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} x"), (4, a), (5, b)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, shingle=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_passages_of_regular_words(spark):
    say = [str(RNG.random()) for _ in range(34)]
    texts = [" ".join([*say, regular(1024)]), " ".join([*say, regular(1024, "b", "a")]), "x " + " ".join([*say, regular(1024)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.repeated_passages(docs).collect()} == {0: 35, 1: 0, 2: 35}


def test_passages_come_from_the_automata(spark, monkeypatch):
    text = " ".join(str(i) for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, f"a {text}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.repeated_passages(docs).collect()] == [200, 200]
    monkeypatch.setattr(substring_dedup, "occurrences", lambda texts, phrases, of: iter(()))
    assert [r.n_removed for r in substring_dedup.repeated_passages(docs).collect()] == [0, 0]


def test_passages_inside_one_text(spark):
    words = [str(RNG.randint(0, 3)) for _ in range(400)]
    once = [str(RNG.random()) for _ in range(50)]
    texts = [" ".join(["x"] * 300), " ".join([*once, "y", *once[:40], "z"]), " ".join(words * 3), " ".join(words), ""]
    seen = Counter(tuple(w[p : p + 35]) for t in texts for w in [t.split()] for p in range(len(w) - 34))
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        want[i] = len({q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.repeated_passages(docs).collect()} == want


def test_occurrences():
    texts = [np.array([1, 2, 3, 1, 2, 3, -1, 20_000]), np.array([3, 1, 2]), np.zeros(0, np.int64)]
    got = sorted(substring_dedup.occurrences(texts, [np.array([1, 2]), np.array([3, 1, 2]), np.array([20_000])], [[0, 2], [0, 1], [1]], per_automaton=2))
    assert got == [(0, 0, 0), (0, 0, 3), (0, 2, 7), (1, 0, 1), (1, 1, 0)]


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a ">', "<p>x", "<b><b></p>", "</x>", "<b>x<p>", "<!", "<!--", "<![CDATA[", "<script>", "<li><b>x", "<a '\">", '<a href="x>y'])
def test_malformed_pages_take_time_by_their_length(piece):
    t = time.process_time()
    html_extract.blocks(piece * (250_000 // len(piece)))
    assert time.process_time() - t < 5


def test_quotes_in_tags():
    assert [t for t, *_ in html_extract.blocks('<p title="a>b">x</p><p title="c>d</p>y')] == ["x", "d", "y"]
    assert [t for t, *_ in html_extract.blocks("a < b <p>c</p> <3")] == ["a < b", "c", "<3"]


def test_long_pages_are_labelled_alike():
    page = html_extract.blocks("<article>" + "<p>some words here</p>" * 9000 + "</article>")
    model = html_extract.Labeller()
    x, mask = model._padded([html_extract.vectors(page)])
    whole = model._both(x, mask)[-1]
    assert np.allclose(whole, model._both(x, mask, keep=False)[-1]) and len(model.label([html_extract.vectors(page)])[0]) == 9000


def test_long_pretokens():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_counts.Counter(P.path("byte_bpe_50k.json"))
    texts = ["".join(RNG.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "aé漢😀", "0123456789", "aaaaab", " \n\t", "!?.") for n in (10, 63, 64, 65, 200, 3000)]
    texts += ["<|endoftext|>", f"{'x' * 500}<|endoftext|>", "a‍b\x00c"]
    assert c.counts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    long_ = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    began = time.process_time()
    assert c.counts([long_]) == [len(t.encode(long_, add_special_tokens=False).ids)]
    assert time.process_time() - began < 5
    with pytest.raises(ValueError):
        token_counts.Counter(P.path("word_bpe_49k.json"))


def test_licences_that_differ_in_a_term_or_a_clause(spark):
    T = license_scan.TEMPLATES
    comment = lambda t, mark=" * ": "/*\n" + "\n".join(mark + x for x in textwrap.wrap(t, 68)) + "\n */\nint main() { return 0; }"
    files = {
        "a/2.c": (comment(T["GPL-2.0"][0]), "GPL-2.0"), "a/3.c": (comment(T["GPL-3.0"][0]), "GPL-3.0"), "b/isc.js": (comment(T["ISC"][0], "// "), "ISC"), "d/notes.txt": ("See the Apache License page.", None), "d/e/own.c": ("int y;", None),
        "b/mit.c": (comment(license_scan._MIT[0]), "MIT"), "f/LICENSE": ("Copyright (c) 2020 X\n\n" + "\n\n".join(textwrap.fill(x, 70) for x in license_scan._MIT), "MIT"), "f/g/h.c": ("nothing", "MIT"), "i/2.c": (comment(T["BSD-2-Clause"][0]), "BSD-2-Clause"),
        "i/3.c": (comment(T["BSD-3-Clause"][0]) + "\n" + comment(T["BSD-3-Clause"][1]), "BSD-3-Clause"), "k/1.c": (comment(T["LGPL-2.1"][0]), "LGPL-2.1"), "l/1.c": (comment(T["AGPL-3.0"][0]), "AGPL-3.0"), "m/1.py": ("# SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), "n/empty": ("", None),
        "n/long.c": (" ".join(str(RNG.random()) for _ in range(20_000)), None),
    }
    rows = [(i, p, t) for i, (p, (t, _)) in enumerate(files.items())] + [(100 + i, f"z/{i}.txt", "words on the weather, a license for version 2 or 3 and any purpose") for i in range(30)]
    got = {r.path: r.license for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).where("id < 100").collect()}
    assert got == {p: want for p, (_, want) in files.items()}


def test_licence_scan_leaves_texts_where_they_are(spark):
    rng = random.Random(5)
    words = [f"w{rng.getrandbits(30)}" for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"d{i}/a.c", f"{say(1000)}\nReleased under the MIT License.\n{say(1000)}") for i in range(400)]
    rows += [rows[0], rows[0], (1000, "e/a.c", "  \n\n"), (1001, "d7/b.c", None)]

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        empty = spark.sparkContext._jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no table is small
    try:
        files = spark.createDataFrame(rows, "id long, path string, text string").repartition(4).localCheckpoint()
        before = shuffled()
        got = license_scan.scan(files).collect()
        moved = sum(n for k, n in shuffled().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.id, r.license, r.found_in) for r in got) == sorted([(i, "MIT", "header") for i in (0, 0, *range(400))] + [(1000, None, None), (1001, None, None)])
    assert moved < sum(len(t or "") for *_, t in rows) / 10


def test_heavy_terms_are_rare_ones_where_those_do():
    weights = {"or": 2.0, "warranty": 11.0, "liability": 11.0, "copyright": 9.0}
    assert license_scan.heavy_terms(weights, Counter({"or": 9, "warranty": 1, "liability": 1, "copyright": 1}), 0.9) == {"warranty", "liability"}


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    names = "_id long, _key string, key long, doc long, h int, one boolean, node long"
    text = " ".join(str(i) for i in range(40))
    rows = [(1, text, "en", "s", 0, *extra) for extra in ((1, "a", 2, 3, 4, True, 5),)] + [(2, f"{text} x", "en", "s", 0, None, None, None, None, None, None, None), (3, None, None, None, None, 1, "b", 1, 1, 1, False, 1), (None, "", None, None, None, 1, "b", 1, 1, 1, False, 1)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for stage, gone in ((toxicity.stage, 0), (exact_dedup.stage, 1), (minhash_dedup.stage, 1), (decontaminate.stage, 0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == max(0, len(table) - (gone if table else 0))
        assert packing.stage(spark, docs, str(tmp_path)).count() == len(table)
    P = pytest.importorskip("public_tokenizers")
    assert token_counts.token_counts(spark.createDataFrame([], schema), P.path("byte_bpe_50k.json")).count() == 0


def test_very_long_texts(spark):
    words = [str(RNG.random()) for _ in range(60_000)]
    long_ = " ".join(words)
    docs = spark.createDataFrame([(1, long_), (2, long_), (3, f"{long_} end"), (4, "short")], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.repeated_passages(docs).collect()} == {1: (60_000, 60_000), 2: (60_000, 60_000), 3: (60_001, 60_000), 4: (1, 0)}
    items = spark.createDataFrame([(7, " ".join(words[30_000:30_050]))], "item_id long, text string")
    n = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()}
    parts = len(re.findall(r"[a-z0-9]+", " ".join(words[30_000:30_050])))
    assert n == {1: parts, 2: parts, 3: parts, 4: 0}
    packed = packing.by_bytes(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {1: len(long_), 2: len(long_), 3: len(long_) + 4, 4: 5}
    assert len(toxicity.toxicity(docs, toxicity.Model()).collect()) == 4
    pages = spark.createDataFrame([(1, "http://a.org/es/" + "x" * 100_000, "<p>" + long_)], "page_id long, url string, html string")
    assert [r.verdict for r in url_filter.judge(pages, url_filter.RULES).collect()] == ["block"]


def test_rows_are_told_apart(spark):
    rows = [(1, "a"), (1, None), (1, ""), (None, "a"), (None, None), (11, ""), (1, "1")]
    df = spark.createDataFrame(rows, "i long, t string")
    assert df.select(tables.row_key("i", "t").alias("k")).distinct().count() == len(rows)


def test_best_fit_query_packs_as_the_plain_search_does(spark):
    """One shard against a search of all bins for the tightest compatible one."""
    rows = [(i, RNG.choice(["s1", "s2", "s3", None]), RNG.choice(["x", "y", "z", None, f"u{i}"]), RNG.choice([0, 5, 10, 30, 30, 99, 100, 250, RNG.randint(1, 400)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, c string, n long")
    got = packing.pack(df, F.col("n"), F.col("c"), 100, per_shard=1000).collect()
    rests = sorted(((i, s, c, n // 100, n % 100) for i, s, c, n in rows if n % 100), key=lambda r: (-r[4], r[0], r[3]))
    bins = []
    want = {}
    for i, s, c, piece, size in rests:
        ok = [b for b in bins if b["left"] >= size and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        tight = min((b["left"] for b in ok), default=None)
        took = [r.bin_id for r in got if (r.doc_id, r.piece) == (i, piece)]
        assert len(took) == 1
        b = next((b for b in ok if b["left"] == tight and b["id"] == took[0]), None)
        assert (b is None) == (not ok)
        if b is None:
            b = {"id": took[0], "left": 100, "s": set(), "c": set()}
            bins.append(b)
        b["left"] -= size
        b["s"].add(s)
        b["c"].add(c)
        want[i, piece] = b["id"]
    assert len({b["id"] for b in bins}) == len(bins) and sum(n // 100 for *_, n in rows) == sum(r.bin_id is not None and r.bin_id.startswith("w-") for r in got)
