"""License scans: MinHash bands over overlapping windows retrieve templates; shingle containment verifies them.

With DataFrame and SQL functions alone and without a shuffle: everything happens in a document's row, against templates
that stand in the expressions, MOST_VALUES values at a time.  A longer list has more passes, each over the rows that the last
one wrote with what it found.

Texts are lower-cased (A-Z) and cut into words of 0-9, a-z and non-ASCII characters; shingles are ``SHINGLE`` words.
A template of t shingles is cut into chunks of c shingles, c being the largest of SCALES up to t (the last chunk
ends with the template).  Documents have windows of 2c shingles that start at each multiple of c, so any run
of c shingles lies in one whole window, and a copied chunk and its window have a Jaccard similarity of at least a
half.  A band is one MinHash value (the least shingle hash after a xor with the band's constant) of BANDS: a copied chunk
is retrieved with a probability of at least 1 - 2 ** -12 = 0.9998, and a template has more than one chunk from 17
shingles on.  With c = 1 a window is one shingle, so retrieval is exact.  Retrieved templates are verified in the whole
text: the share of their distinct shingles, word by word, that occur there is at least ``containment``.

Defined cases: null and empty texts hold no license; repeated rows give one row each; a text of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, materialize

SHINGLE = 5
BANDS = 12
SCALES = (1, 4, 16)
#: Templates and their bands take at most so many values in a pass's expressions (one template alone may take more).
MOST_VALUES = 50_000

#: Public license notices.  Name, allowed for training, text.
TEMPLATES = [
    ("apache-2.0", True, "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", True, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd-2-clause", True, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by-4.0", True, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", False, "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", True, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", False, "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-notice", False, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("isc", True, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", True, "Released under the MIT License"),
    ("mit-notice", True, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mpl-2.0", True, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", True, """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]


def _masks(spark: SparkSession) -> list[int]:
    """A constant for each band, from a rule; the first leaves hashes as they are."""
    return [0] + [((i * 0x9E3779B97F4A7C15) ^ (i << 59)) % (1 << 64) - (1 << 63) for i in range(1, BANDS)]


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once a row and uses it in ``body`` as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _words(text: str) -> str:
    return f"filter(split(translate({text}, '{UPPER}', '{UPPER.lower()}'), r'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), x -> x <> '')"


def _shingle_hashes(w: str) -> str:
    each = ", ".join(f"get({w}, i + {k})" for k in range(SHINGLE))
    return f"if(size({w}) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, size({w}) - {SHINGLE}), i -> xxhash64({each})))"


def _window_values(h: str, masks: list[int]) -> str:
    """SQL for band values of all windows of a document's shingle hashes ``h``.

    The least value of a window of 2c shingles is the least value of one of its halves, so the values of the runs of c
    shingles hold those of all windows; templates that runs alone retrieve are for the verification to judge.  Runs of 16
    build on runs of 4, each of which yields its values for all bands in one step."""
    empty = "cast(array() as array<bigint>)"
    four = ", ".join(f"least({', '.join(f'q.x{k} ^ {m}L' for k in range(4))})" for m in masks)
    members = ", ".join(f"'x{k}', get({h}, 4 * j + {k})" for k in range(4))
    fours = f"transform(sequence(0, (size({h}) - 1) div 4), j -> {_let('q', f'named_struct({members})', f'array({four})')})"
    sixteen = ", ".join(f"least({', '.join(f'get(get(a, 4 * j + {k}), {i})' for k in range(4))})" for i in range(len(masks)))
    sixteens = f"transform(sequence(0, (size(a) - 1) div 4), j -> array({sixteen}))"
    return f"if(size({h}) = 0, {empty}, {_let('a', fours, f'concat({h}, flatten(a), flatten({sixteens}))')})"


def _template_table(spark: SparkSession, templates: list[tuple[str, bool, str]], masks: list[int]) -> list[tuple]:
    """name, shingles (strings), band values of each template; computed with the same functions as documents'."""
    rows = spark.createDataFrame([(n, t) for n, _, t in templates], "name string, text string")
    chunk = f"case {' '.join(f'when size(h) >= {c} then {c}' for c in sorted(SCALES, reverse=True))} else 0 end"
    starts = "array_distinct(concat(transform(sequence(0, (size(h) - c) div c), k -> k * c), array(size(h) - c)))"
    values = ", ".join(f"array_min(transform(slice(h, s + 1, c), x -> x ^ {m}L))" for m in masks)
    rows = rows.withColumn("w", F.expr(_words("text"))).withColumn("h", F.expr(_shingle_hashes("w"))).withColumn("c", F.expr(chunk))
    bands = f"if(c = 0, cast(array() as array<bigint>), if(c = 1, h, flatten(transform({starts}, s -> array({values})))))"
    shingles = f"array_distinct(transform(sequence(1, size(w) - {SHINGLE - 1}), i -> array_join(slice(w, i, {SHINGLE}), ' ')))"
    return rows.select("name", F.expr(shingles).alias("shingles"), F.expr(f"array_distinct({bands})").alias("bands")).collect()


def find_licenses(docs: DataFrame, templates: list[tuple[str, bool, str]] = TEMPLATES, *, containment: float = 0.8, most_values: int = MOST_VALUES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, matches (array of name, containment, first_word, last_word, sorted by name): a row for each row of
    ``docs``.  Words are numbered from 0, last_word is exclusive."""
    short = [n for n, _, t in templates if len(t.split()) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    masks = _masks(docs.sparkSession)
    passes: list[list] = []
    size = 0
    for r in _template_table(docs.sparkSession, templates, masks):
        n = len(r.bands) + len(r.shingles)
        if not passes or size + n > most_values:
            passes.append([])
            size = 0
        passes[-1].append(r)
        size += n
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("matches", F.expr("cast(array() as array<struct<name:string,containment:double,first_word:bigint,last_word:bigint>>)"))
    for i, table in enumerate(passes):
        rows = rows if not i else materialize(rows, "license-matches")
        found, more = _matches(table, masks, containment)
        rows = rows.withColumn("found", found).select("doc_id", "text", F.concat("matches", F.expr(more)).alias("matches"))
    return rows.select("doc_id", F.array_sort("matches").alias("matches"))


def _matches(table: list, masks: list[int], containment: float) -> tuple[F.Column, str]:
    """The templates of a pass that the column text retrieves, and SQL for the matches among them, which have the name found."""
    by_value: dict[int, list[int]] = {}
    for i, r in enumerate(table):
        for v in r.bands:
            by_value.setdefault(v, []).append(i)
    known = F.array(*[F.lit(v).cast("bigint") for v in by_value])
    owners = F.create_map(*[x for v, o in by_value.items() for x in (F.lit(v).cast("bigint"), F.array(*[F.lit(i) for i in o]))])
    values = _let("w", _words("text"), _let("h", _shingle_hashes("w"), _window_values("h", masks)))
    hits = F.array_intersect(F.expr(values), known)
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda v: F.element_at(owners, v)))))
    # Retrieved templates in the whole text; most rows have none and stop here.
    shingles = f"if(size(w) < {SHINGLE}, cast(array() as array<string>), transform(sequence(1, size(w) - {SHINGLE - 1}), i -> array_join(slice(w, i, {SHINGLE}), ' ')))"
    cases = " ".join(f"when {i} then array({', '.join(_quoted(s) for s in r.shingles)})" for i, r in enumerate(table))
    names = f"array({', '.join(_quoted(r.name) for r in table)})"
    match = f"""named_struct('name', get({names}, t), 'containment', size(array_intersect(g, tpl)) / size(tpl),
        'at', filter(transform(g, (x, i) -> if(array_contains(tpl, x), i, null)), i -> i is not null))"""
    verified = f"""transform(filter(transform(found, t -> {_let('tpl', f'case t {cases} end', match)}), m -> m.containment >= {containment}),
        m -> named_struct('name', m.name, 'containment', m.containment, 'first_word', cast(array_min(m.at) as bigint), 'last_word', cast(array_max(m.at) + {SHINGLE} as bigint)))"""
    none = "cast(array() as array<struct<name:string,containment:double,first_word:bigint,last_word:bigint>>)"
    matches = f"if(size(found) = 0, {none}, {_let('w', _words('text'), _let('g', shingles, verified))})"
    return found, matches


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def report(found: DataFrame, templates: list[tuple[str, bool, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses (name:first_word:last_word, comma-joined by name), verdict: none, allowed, or
    denied if any license found is not for training."""
    allowed = F.array(*[F.lit(n) for n, ok, _ in templates if ok])
    names = F.transform("matches", lambda m: F.concat(m["name"], F.lit(":"), m["first_word"].cast("string"), F.lit(":"), m["last_word"].cast("string")))
    denied = F.exists("matches", lambda m: ~F.array_contains(allowed, m["name"]))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.when(F.size("matches") == 0, "none").when(denied, "denied").otherwise("allowed").alias("verdict"))
