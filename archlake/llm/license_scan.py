"""Licence scans by sparse TF-IDF cosine and directory inheritance, in DataFrame operations only.

Each line of every file, and each block of several lines (without comment
marks, up to the next blank line), is a possible notice; a file that is named
as a licence (LICENSE, COPYING and the like) is scored as a whole too. All
terms of all files, not only the templates', are counted for their inverse
document frequency. A piece can only reach the threshold with one of its
template's heavy terms (those without which the rest of the template is too
short a vector, the rarest in files first), so only pieces that hold such a term
are scored. No weight is less than 1, which bounds a vector's length from below
before its other terms are weighed: pieces that are too long for their threshold
even so go no further. Neither step loses a notice. Both are done in the task
that reads the text: only pieces near a template go on, and texts don't move. Between licences that differ in a version
or a clause that term decides: a piece must have one of the licence's own terms
and none of another's. A file without a notice of its own inherits from the
licence file in its nearest ancestor directory, by joining all its ancestors'
paths.

Nulls and empty texts have no notice but inherit. A null path is a file in
the root. Equal scores go to the lesser template name; of several licence
files in a directory the best match counts, then the least path. Repeated
rows are scanned alike; very long lines and files are scored whole; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
#: Public notices by licence.
TEMPLATES = {
    "AGPL-3.0": [_GNU.format(what="program", name="Affero General Public License", version="3"), "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": [_BSD, "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [_BSD, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": [_GNU.format(what="program", name="General Public License", version="2"), "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": [_GNU.format(what="program", name="General Public License", version="3"), "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": [_ISC, "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": [_GNU.format(what="library", name="Lesser General Public License", version="2.1"), "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": [_GNU.format(what="library", name="Lesser General Public License", version="3"), "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.", *_MIT, " ".join(_MIT), "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
}
#: Of these terms a licence's piece has one of the first and none of the second.
DECIDES = {
    "AGPL-3.0": (["affero", "agpl"], ["lesser"]),
    "Apache-2.0": (["2", "2.0"], []),
    "CC-BY-4.0": (["4.0"], ["nc", "noncommercial", "nd", "noderivatives", "sa", "sharealike"]),
    "CC-BY-NC-4.0": (["nc", "noncommercial"], ["nd", "noderivatives", "sa", "sharealike"]),
    "EPL-2.0": (["2.0"], []),
    "GPL-2.0": (["2", "2.0", "gplv2"], ["lesser", "lgpl", "affero", "agpl", "3", "3.0", "gplv3"]),
    "GPL-3.0": (["3", "3.0", "gplv3"], ["lesser", "lgpl", "affero", "agpl"]),
    "LGPL-2.1": (["2.1", "lgplv2.1"], ["affero", "agpl"]),
    "LGPL-3.0": (["lesser", "lgpl"], ["2.1", "affero", "agpl"]),
    "MPL-2.0": (["2.0"], []),
}
TELLING = sorted({t for some, none in DECIDES.values() for t in some + none})
#: A clause by which whole files of these two licences differ.
CLAUSE, WITH_CLAUSE, WITHOUT_CLAUSE = r"(?i)\bendorse\s+or\s+promote\b|\bBSD[ -]3", "BSD-3-Clause", "BSD-2-Clause"
NAMED = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)([._-][^/]*)?$|(?i)[.]licen[cs]e$"
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--+|\"{3}|'{3})?[ \t]*|[ \t]*(?:\*+/|--+>|\"{3}|'{3})?[ \t]*$"
BREAK = "\r\n|\r|\n"
_TERM = r"[a-z0-9]+(?:[.][0-9]+)*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _templates() -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(_TERM, form.lower()))) for name, forms in TEMPLATES.items() for form in forms]


def heavy_terms(weights: dict[str, float], tf: Counter, threshold: float) -> set[str]:
    """Terms without which the template's rest can't reach the threshold; the rarest in files come first, so that few files hold one."""
    mass = {t: (n * weights[t]) ** 2 for t, n in tf.items()}
    left, whole, out = sum(mass.values()), sum(mass.values()), set()
    for t in sorted(mass, key=lambda t: (-weights[t], -mass[t], t)):
        if left < threshold**2 * whole:
            break
        out.add(t)
        left -= mass[t]
    return out


def any_of(terms: set[str]) -> str:
    """A pattern for any of the terms that looks at each of their common beginnings once."""
    by: dict[str, set[str]] = {}
    for t in terms:
        if t:
            by.setdefault(t[0], set()).add(t[1:])
    parts = [re.escape(c) + (any_of(rest) if rest != {""} else "") for c, rest in sorted(by.items())]
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in terms else "") if parts else ""


def _pieces(text: Column, path: Column) -> Column:
    """at and text: lines from 0 on, the whole of a licence file at -1, blocks of several lines from -2 downwards."""
    lines = F.transform(F.split(text, BREAK), lambda x, i: F.struct(i.cast("int").alias("at"), x.alias("text")))
    plain = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), MARKS, "")
    blocks = F.transform(F.split(plain, "\n{2,}"), lambda x, i: F.struct((-2 - i).cast("int").alias("at"), F.trim(x, F.lit("\n")).alias("text")))
    blocks = F.filter(blocks, lambda x: x["text"].contains("\n"))
    whole = F.when(path.rlike(NAMED), F.array(F.struct(F.lit(-1).alias("at"), text))).otherwise(F.array().cast("array<struct<at:int,text:string>>"))
    return F.concat(lines, blocks, whole)


def decided(license_: Column, own: Column) -> Column:
    """Whether a piece with these terms may be of this licence."""
    out = F.lit(True)
    for name, (some, none) in DECIDES.items():
        ok = F.arrays_overlap(own, F.array(*map(F.lit, some)))
        out = F.when(license_ == name, ok & ~F.arrays_overlap(own, F.array(*map(F.lit, none))) if none else ok).otherwise(out)
    return out


def _numbers(values: Iterable[float]) -> Column:
    """The numbers as one array, which Spark folds into a literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _run(last: int | Column, length: int | Column, mass: float | Column) -> Column:
    parts = ((last, "last", "int"), (length, "length", "long"), (mass, "mass", "double"))
    return F.struct(*((x if isinstance(x, Column) else F.lit(x)).cast(kind).alias(name) for x, name, kind in parts))


def _more(a: Column, i: Column, weights: Column) -> Column:
    """Adds a number to the squares of all counts by weight; numbers come in order, so a count is a run of one number."""
    length = F.when(a["last"] == i, a["length"]).otherwise(0)
    return _run(i, length + 1, a["mass"] + (2 * length + 1) * F.pow(weights[i], 2))


def scan(files: DataFrame, line_threshold: float = 0.7, file_threshold: float = 0.3) -> DataFrame:
    """files: id, path, text. Returns id, path, license, found_in (header, file, inherited), score_permille, from_dir."""
    files = files.select(F.col("id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    templates = _templates()
    vocabulary = sorted(set().union(*(tf for _, tf in templates)))
    # Of all files: how many there are and how many hold each term.
    n = files.count()
    held_by = tables.cut(files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("t")).groupBy("t").agg(F.count("*").alias("df")))
    df = dict(held_by.where(F.col("t").isin(vocabulary)).collect())  # the vocabulary bounds the rows
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    heavy = {t: set().union(*(heavy_terms(idf, tf, max(0, x - 0.001)) for _, tf in templates)) for t, x in (("line", line_threshold), ("file", file_threshold))}
    word = lambda terms: f"(?i)(?<![a-z0-9]){any_of(terms)}(?![a-z0-9])"
    marked = F.col("text").rlike(word(heavy["line"])) | (F.col("path").rlike(NAMED) & F.col("text").rlike(word(heavy["file"])))
    # A row for each file, with no piece, and one for each of its pieces: what is near a template is found where the text is read, so texts don't move.
    pieces = F.filter(_pieces(F.col("text"), F.col("path")), lambda x: x["text"].rlike(word(heavy["line"])) | (x["at"] == -1))
    none = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("text")))
    rows = files.select("*", F.monotonically_increasing_id().alias("row"), marked.alias("marked"))
    rows = rows.select("row", "id", "path", F.when(F.col("marked"), F.col("text").rlike(CLAUSE)).alias("clause"), F.explode(F.when(F.col("marked"), F.concat(none, pieces)).otherwise(none)).alias("x"))
    rows = rows.select("row", "id", "path", "clause", "x.at", _terms(F.col("x.text")).alias("terms"))
    # The templates' terms by number, in order, and their weights; the other terms' weights aren't known yet.
    number = lambda t: F.array_position(F.array(*map(F.lit, vocabulary)), t).cast("int") - 1
    known = F.sort_array(F.transform(F.filter("terms", lambda t: t.isin(vocabulary)), number))
    own = F.array_intersect("terms", F.array(*map(F.lit, TELLING)))
    rows = rows.select("row", "id", "path", "clause", "at", known.alias("known"), F.filter("terms", lambda t: ~t.isin(vocabulary)).alias("others"), own.alias("own"))
    rows = rows.select("*", F.aggregate("known", _run(-1, 0, 0.0), lambda a, i: _more(a, i, _numbers(idf[t] for t in vocabulary)))["mass"].alias("mass"))
    length = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items())) for _, tf in templates]
    parts = _numbers(tf[t] * idf[t] * idf[t] / length[i] for i, (_, tf) in enumerate(templates) for t in vocabulary)
    forms = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(i * len(vocabulary)).alias("first")) for i, (name, _) in enumerate(templates)))
    dots = F.transform(forms, lambda f: F.struct(f["license"].alias("license"), F.aggregate("known", F.lit(0.0), lambda a, i: a + parts[f["first"] + i]).alias("dot")))
    # Other terms weigh 1 at least.
    limit = (F.when(F.col("at") == -1, file_threshold).otherwise(line_threshold) - 0.001) * F.sqrt(F.col("mass") + F.size("others"))
    near = F.filter(dots, lambda d: (d["dot"] > 0) & (d["dot"] >= limit))
    # The piece's number also keeps Spark from computing the templates once more for the filter.
    rows = rows.select("row", "id", "path", "clause", "at", "others", "own", "mass", near.alias("near"), F.monotonically_increasing_id().alias("piece"))
    rows = tables.cut(rows.where(F.col("at").isNull() | (F.size("near") > 0)))
    close = rows.where("at is not null")
    # The full vectors of the pieces left.
    counts = close.select("piece", F.explode("others").alias("t")).groupBy("piece", "t").agg(F.count("*").alias("tf"))
    weight = F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1
    rest = counts.join(held_by, "t").groupBy("piece").agg(F.sum(F.pow(F.col("tf") * weight, 2)).alias("rest"))
    scored = close.select("row", "path", "clause", "at", "own", "mass", "piece", F.explode("near").alias("d")).join(rest, "piece", "left").select("*", "d.*")
    scored = scored.where(decided(F.col("license"), F.col("own")))
    scored = scored.where(((F.col("license") != WITH_CLAUSE) | F.col("clause")) & ((F.col("license") != WITHOUT_CLAUSE) | ~F.col("clause")))
    norm = F.sqrt(F.col("mass") + F.coalesce("rest", F.lit(0.0)))
    scored = tables.cut(scored.select("row", "path", "at", "license", F.round(1000 * F.col("dot") / norm).cast("int").alias("score")))
    best = lambda x: F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias(x)
    header = scored.where((F.col("at") != -1) & (F.col("score") >= 1000 * line_threshold)).groupBy("row").agg(best("h_license"), F.max("score").alias("h_score"))
    whole = scored.where((F.col("at") == -1) & (F.col("score") >= 1000 * file_threshold)).groupBy("row", "path").agg(best("f_license"), F.max("score").alias("f_score"))
    own = tables.cut(header.join(whole, "row", "full"))
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    rows = rows.where("at is null").select("row", "id", "path", parent.alias("dir"))
    named = rows.join(own.drop("path"), "row", "left")
    held = tables.cut(own.where("f_license is not null").groupBy(parent.alias("up")).agg(F.min_by(F.struct("f_license", "f_score"), F.struct(-F.col("f_score"), F.col("path"))).alias("d")))
    # All ancestors of a directory, itself and the root among them.
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))
    dirs = rows.select("dir").distinct().select("dir", F.explode(F.array_distinct(up)).alias("up"))
    near = tables.cut(dirs.join(held, "up").groupBy("dir").agg(F.max_by(F.struct("d", "up"), F.length("up")).alias("n")))
    out = named.join(near, "dir", "left")
    kind = F.when(F.col("f_license").isNotNull(), "file").when(F.col("h_license").isNotNull(), "header").when(F.col("n").isNotNull(), "inherited")
    return out.select(
        "id", "path", F.coalesce("f_license", "h_license", "n.d.f_license").alias("license"), kind.alias("found_in"),
        F.coalesce("f_score", "h_score", "n.d.f_score").alias("score_permille"), F.when(kind == "inherited", F.col("n.up")).alias("from_dir"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/lang/hundred/doc_id.txt, each hundredth the licence file of its directory."""
    d = tables.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100").cast("string"), F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return scan(d.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")
