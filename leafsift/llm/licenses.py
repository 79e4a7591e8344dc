"""License scans with DataFrame functions only: MinHash bands retrieve templates, exact shingle containment verifies them.

A text is read as words (runs of a-z and 0-9, in lower case) and shingles of five words. Templates, a table of whole texts, are cut into pieces of at
most ``PIECE`` shingles; a text is read in windows of 2 * PIECE shingles, each PIECE after the last, so every run as long as a piece lies inside a window.

A window is compared with a piece after it has been reduced to that piece's own shingles, whatever else stands in it: what is left resembles
the piece by the share c of the piece that the window holds. Each of ``BANDS`` bands is the smallest shingle of the piece under a hash of its own, and the reduced window has
the same smallest one just if it holds that shingle. So bands are a table of shingles, and retrieval is one equi-join of the texts' distinct shingles with
it; no text meets a template it shares no band with. A piece of no more shingles than bands is retrieved by each of them.

If a template's containment reaches ``least``, one of its pieces at least has c >= ``least`` in a window, and is missed by all bands with probability (1 - c) ** BANDS: below
7e-12 at 0.8, and never for pieces of up to BANDS shingles. Templates retrieved for a text are verified whole: the share of the template's distinct shingles that its pieces find in
their best windows must reach ``least``.

Scale: retrieval shuffles a row for each retrieved pair only; the bands are broadcast where Spark finds them small, else texts with a frequent shingle are split.
Texts are told apart by their MD5, so copies are verified once, and only retrieved texts are sent. Defined results: a null or empty text, and one of under five words, has no
license; a template of under five words is never found; of templates of one name the last text by order counts. Repeated rows each give their own row; a null doc_id is kept; other
columns are not read. A very long text is one row's array of shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import stored

SHINGLE, PIECE, BANDS = 5, 32, 16
LICENSES = "array<struct<name:string,containment:double>>"

#: Notices as they stand in files; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """One hash for each run of SHINGLE words, in order."""

    def body(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - SHINGLE)
        run = F.transform(at, lambda i: F.xxhash64(*(hashes[i + k] for k in range(SHINGLE))))
        return F.when(F.size(hashes) >= SHINGLE, run).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), body)


def pieces_of(templates: DataFrame) -> DataFrame:
    """(name, total, pieces) of ``templates(name, text)``: the distinct shingles in pieces, each in the first that has it."""
    rows = templates.groupBy(F.col("name").cast("string").alias("name")).agg(F.max(F.col("text").cast("string")).alias("text"))
    rows = rows.select("name", F.array_distinct(shingles_of(words_of(F.col("text")))).alias("s")).filter((F.size("s") > 0) & F.col("name").isNotNull())
    cut = F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(PIECE)), lambda at: F.slice("s", at + 1, PIECE))
    return rows.select("name", F.size("s").alias("total"), cut.alias("pieces"))


def bands_of(pieces: DataFrame) -> DataFrame:
    """(shingle, name): the shingles that retrieve a template."""
    least = lambda s, band: F.array_min(F.transform(s, lambda x: F.struct(F.xxhash64(F.lit(band), x).alias("h"), x.alias("x"))))["x"]
    each = pieces.select("name", F.explode("pieces").alias("s"))
    kept = F.when(F.size("s") <= BANDS, F.col("s")).otherwise(F.array_distinct(F.array(*(least(F.col("s"), band) for band in range(BANDS)))))
    return each.select(F.explode(kept).alias("shingle"), "name").distinct()


def containment(shingles: Column, pieces: Column, total: Column) -> Column:
    """The share of a template's shingles that its pieces find in their best windows of a text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(shingles) - 1), F.lit(PIECE))
    windows = F.transform(starts, lambda at: F.slice(shingles, at + 1, 2 * PIECE))
    best = lambda held, piece: F.array_max(F.transform(held, lambda w: F.size(F.array_intersect(w, piece))))
    return let(windows, lambda held: F.aggregate(pieces, F.lit(0), lambda n, piece: n + best(held, piece))) / total.cast("double")


def retrieve(texts: DataFrame, bands: DataFrame) -> DataFrame:
    """(key, name) of the texts and templates that share a band."""
    shingles = texts.select("key", F.explode(F.array_distinct(shingles_of(words_of(F.col("text"))))).alias("shingle"))
    return shingles.join(bands, "shingle").select("key", "name").distinct()


def scan(docs: DataFrame, templates: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, licenses) for every row: an array of (name, containment), by name. ``templates(name, text)`` are the fixed notices unless given."""
    if templates is None:
        templates = docs.sparkSession.createDataFrame(list(TEMPLATES.items()), "name string, text string")
    pieces = stored(pieces_of(templates), "license-pieces")
    bands = stored(bands_of(pieces), "license-bands")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("string").cast("binary")).alias("key"), F.col("text").cast("string").alias("text"))
    pairs = stored(retrieve(texts.select("key", "text"), bands), "license-pairs")
    # copies of a text are one row from here on; sums in each task come before the shuffle
    keys = pairs.select("key").distinct().hint("merge")  # the same plan at every size: texts meet the keys by shuffle
    held = texts.select("key", "text").join(keys, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    held = held.select("key", shingles_of(words_of(F.col("text"))).alias("shingles"))
    share = containment(F.col("shingles"), F.col("pieces"), F.col("total"))
    found = held.join(pairs, "key").join(pieces, "name").select("key", F.struct("name", share.alias("containment")).alias("f")).filter(F.col("f.containment") >= least)
    found = found.groupBy("key").agg(F.array_sort(F.collect_list("f")).alias("licenses"))  # no more than templates
    return texts.select("doc_id", "key").join(found, "key", "left").select("doc_id", F.coalesce("licenses", F.array().cast(LICENSES)).alias("licenses"))
