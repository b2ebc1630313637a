"""License scans, in DataFrame and SQL functions only.

Texts and templates are words (lower-cased runs of letters and digits) and five-word shingles. The shingles are cut into windows of
WINDOW shingles that overlap by half, and each window has HASHES minimum hashes, each a band of its own. A template whose windows, taken
at every offset, share a band with a window of the text is retrieved; then the share of the template's shingles that the text holds is
computed exactly, from the words themselves, and a template is reported at CONTAINMENT or more.

Collisions: a text that holds four fifths of a template's shingles has a window with at least that share of one of the template's, a
Jaccard similarity of 2/3 or more, which is missed with a probability of (1/3) ** HASHES = 0.0014 for that window alone, and a template
has several. A text that holds a template as it stands has a window that equals one of the template's, and cannot be missed. Templates
of fewer than LONG shingles have windows of one shingle, whose band is the shingle: any shingle in common retrieves them.

Retrieval and verification look only at the text's own row and at the templates, which are a fixed list; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

WORDS = 5
WINDOW = 8
HASHES = 6
LONG = 12
CONTAINMENT = 0.8

#: Notices of public licenses as they are usually stated, and statements of one line.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-statement": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct shingles of each template, in order; templates of fewer than WORDS words are refused."""
    out = {}
    for name, text in templates.items():
        w = template_words(text)
        if len(w) < WORDS:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        out[name] = list(dict.fromkeys(" ".join(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)))
    return out


def shingle_hashes(w: Column) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    at = F.sequence(F.lit(0), F.size(w) - WORDS)
    return F.when(F.size(w) >= WORDS, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))).otherwise(F.array().cast("array<bigint>"))


def band_hash(h: Column, band: int) -> Column:
    return F.xxhash64(h, F.lit(band))


def window_minima(h: Column, band: int, step: int) -> Column:
    """Minimum hash of each window of WINDOW shingles, one window starting at every step-th shingle."""
    hashed = F.transform(h, lambda x: band_hash(x, band))
    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(step))
    # the hashes are bound to a name once; written inside of the function they would be taken anew for every window
    return F.get(F.transform(F.array(hashed), lambda x: F.transform(starts, lambda i: F.array_min(F.slice(x, i + 1, WINDOW)))), F.lit(0))


def _literal(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def band_keys(spark: SparkSession, templates: dict[str, str]) -> tuple[dict[str, list[int]], list[dict[str, list[int]]]]:
    """Shingle hashes of the short templates, and for each band the window minima of the long ones, at every offset."""
    rows = spark.createDataFrame([(name, template_words(text)) for name, text in templates.items()], "name string, w array<string>")
    h = shingle_hashes(F.col("w"))
    found = rows.select("name", h.alias("h")).select("name", "h", *[window_minima(F.col("h"), b, 1).alias(f"b{b}") for b in range(HASHES)]).collect()
    # windows that run over the end hold fewer shingles; only whole ones are templates' windows
    whole = lambda r, b: sorted(set(r[f"b{b}"][: len(r["h"]) - WINDOW + 1]))
    short = {r["name"]: sorted(set(r["h"])) for r in found if len(r["h"]) < LONG}
    return short, [{r["name"]: whole(r, b) for r in found if len(r["h"]) >= LONG} for b in range(HASHES)]


def scan_licenses(df: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """One row (key, license, containment, first_word) for each template that a text holds; first_word counts words from 0.

    Null, empty and short texts hold none. Repeated rows are reported alike. Other columns are dropped.
    """
    spark = df.sparkSession
    short, bands = band_keys(spark, templates)
    shingle_lists = template_shingles(templates)
    base = df.select(F.col(key), words(F.col(text)).alias("w")).withColumn("h", shingle_hashes(F.col("w")))
    hits = [F.arrays_overlap("h", _literal(v)).alias(n) for n, v in short.items()]
    # arrays of retrieved names: those of short templates, then those of long ones by band
    names: list[Column] = [F.when(hit, F.lit(n)) for n, hit in zip(short, hits, strict=True)]
    if bands[0]:
        base = base.withColumn("m", F.array(*[window_minima(F.col("h"), b, WINDOW // 2) for b in range(HASHES)]))
        any_hit = None
        for b, by_name in enumerate(bands):
            hit = F.arrays_overlap(F.get("m", F.lit(b)), _literal(sorted({v for values in by_name.values() for v in values})))
            any_hit = hit if any_hit is None else any_hit | hit
        base = base.withColumn("long_hit", any_hit)
        for n in bands[0]:
            one = None
            for b, by_name in enumerate(bands):
                hit = F.arrays_overlap(F.get("m", F.lit(b)), _literal(by_name[n]))
                one = hit if one is None else one | hit
            names.append(F.when(F.col("long_hit") & one, F.lit(n)))
    # a filter does not move below a column that is not deterministic; there, it would repeat every expression under its arrays
    found = base.select(key, "w", F.filter(F.array(*names), lambda x: x.isNotNull()).alias("names"), F.monotonically_increasing_id().alias("row"))
    found = found.where((F.size("names") > 0) & (F.col("row") >= 0))
    at = F.sequence(F.lit(0), F.size("w") - WORDS)
    texts = found.select(key, F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, WORDS), " ")).alias("s"), F.explode("names").alias("license"))
    lists = F.create_map(*[x for n, s in shingle_lists.items() for x in (F.lit(n), F.split(F.lit("|".join(s)), r"\|"))])
    held = texts.withColumn("own", F.element_at(lists, F.col("license"))).withColumn("both", F.array_intersect("own", "s"))
    scored = held.withColumn("containment", F.size("both") / F.size("own")).withColumn("row", F.monotonically_increasing_id())
    scored = scored.where((F.col("containment") >= least) & (F.col("row") >= 0))
    return scored.select(key, "license", F.round("containment", 6).alias("containment"), (F.array_min(F.transform("both", lambda x: F.array_position("s", x))) - 1).alias("first_word"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op1_sql(templates: dict[str, str] = TEMPLATES, least: float = CONTAINMENT) -> str:
    """DuckDB: the containment of every template in every document."""
    listed = ", ".join(f"('{n}', '{s}', {len(v)})" for n, v in template_shingles(templates).items() for s in v)
    return f"""
WITH t(license, s, n) AS (VALUES {listed}),
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(len(w) - {WORDS - 1})) AS i, w FROM w WHERE len(w) >= {WORDS}),
s AS (SELECT r, doc_id, array_to_string(w[i + 1 : i + {WORDS}], ' ') AS s, min(i) AS i FROM p GROUP BY ALL),
f AS (SELECT r, doc_id, license, round(count(*) / any_value(n), 6) AS containment, min(i) AS first_word FROM s JOIN t USING (s) GROUP BY r, doc_id, license)
SELECT doc_id, license, containment, first_word FROM f WHERE containment >= {least}"""
