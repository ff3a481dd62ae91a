"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Every line, every sentence, every paragraph of several lines and every text of several paragraphs is a segment. Its
bigrams are joined with those of the templates whose size can still reach the threshold, and shared bigrams are counted.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
MOST_TEMPLATES = 2_000
SHORT_MARKER = 5  #: letters up to which a marker is sought as a whole word
MOST_MARKERS = 256  #: words that texts are first looked through for; where templates need more, all texts are cut into segments
SENTENCE_END = r"[.!?][\x20\x09-\x0D]+"
# Public licence texts (fixed values).
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
)
#: Notices, grants, warranties and short licences whole, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-grant": MIT[0],
    "MIT-notice": MIT[1],
    "MIT-warranty": MIT[2],
    "MIT-license": " ".join(MIT),
    "Apache-2.0-grant": APACHE[0],
    "Apache-2.0-warranty": APACHE[1],
    "Apache-2.0-header": " http://www.apache.org/licenses/LICENSE-2.0 ".join(APACHE),
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-warranty": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "GPL-grant": GPL[0],
    "GPL-warranty": GPL[1],
    "GPL-header": " ".join(GPL),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def bigrams(text: Column) -> Column:
    """Different pairs of neighbouring words; a word is a run of ASCII letters and digits of the lower-case text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    one = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), w[i + 1])))), 1)
    return F.array_distinct(one)


def markers(texts: list[str], least: float) -> list[str]:
    """Words of which every segment that matches one of the texts holds one at least; none if that cannot be had.

    A match shares so many of a text's b bigrams: ``least`` times half of b and of the smaller size that the bound allows. So it
    has a bigram with a marker once fewer than these have none. Long words come first, and words already chosen count.
    """
    chosen: list[str] = []
    for text in texts:
        own = re.findall("[a-z0-9]+", text.lower())
        pairs = set(zip(own, own[1:]))
        shared = math.ceil(least * (1 + least / (2 - least)) / 2 * len(pairs) - 1e-9)
        bare = {p for p in pairs if not any(m in p for m in chosen)}
        for word in sorted(set(own), key=lambda w: (-len(w), w)):
            if len(bare) < shared:
                break
            if any(word in p for p in bare):
                chosen.append(word)
                bare = {p for p in bare if word not in p}
    return chosen


def scan(df: DataFrame, templates: DataFrame, id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """A row for each segment that matches: id, kind, segment_no, license, dice.

    templates (license, text) is broadcast if it has ``MOST_TEMPLATES`` rows at most. kind is line, sentence (of a text of
    several, up to a full stop, question or exclamation mark before white space), paragraph or text; segments count from
    0 within their kind. license is the template of the greatest coefficient, ``least`` or more; ties go to the name
    first in order. Segments and templates without two words, null and empty texts match nothing. Repeated rows repeat
    their matches. Other columns of df are dropped, whatever their names.
    """
    own = templates.select("license", F.explode(bigrams(F.col("text"))).alias("g")).distinct()
    sized = own.groupBy("license").agg(F.count("*").alias("b"))
    low, high = sized.agg(F.coalesce(F.min("b"), F.lit(1)), F.coalesce(F.max("b"), F.lit(0))).first()
    ratio = least / (2 - least)  # the smaller size over the larger, at the threshold

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    paragraphs = F.split(whole, r"\n[\x20\x09-\x0D]*\n")
    sentences = F.split(whole, SENTENCE_END)
    parts = {"line": F.split(whole, "\n"), "sentence": F.when(F.size(sentences) > 1, sentences).otherwise(F.array().cast("array<string>")), "paragraph": F.transform(paragraphs, lambda p: F.when(F.contains(p, F.lit("\n")), p)), "text": F.array(F.when(F.size(paragraphs) > 1, whole))}
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), part.alias("parts")) for kind, part in parts.items()])
    # a row is told by its id and its text, so that a task run again gives it the same name; repeated rows are counted
    listed = [r["text"] for r in templates.limit(MOST_TEMPLATES + 1).select("text").collect()]
    found = markers([t for t in listed if t], least) if len(listed) <= MOST_TEMPLATES else []
    sought = df
    if 0 < len(found) <= MOST_MARKERS:  # texts without any marker match nothing, in whole or in part
        small_letters = F.lower(F.col(text).cast("string"))
        long, short = [m for m in found if len(m) > SHORT_MARKER], [m for m in found if len(m) <= SHORT_MARKER]
        held = [F.contains(small_letters, F.lit(m)) for m in long] + [small_letters.rlike(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])") for _ in short[:1]]
        sought = df.where(reduce(Column.__or__, held))
    keyed = sought.select(F.col(id).alias("id"), F.xxhash64(whole).alias("row"), kinds.alias("kinds"))
    times = df.groupBy(F.col(id).alias("id"), F.xxhash64(whole).alias("row")).agg(F.count("*").alias("times")).where("times > 1")
    rows = keyed.select("id", "row", F.explode("kinds").alias("s"))
    rows = rows.select("id", "row", "s.kind", F.posexplode("s.parts").alias("segment_no", "part")).where("part is not null")
    rows = rows.select("id", "row", "kind", "segment_no", bigrams(F.col("part")).alias("own")).withColumn("a", F.size("own"))
    rows = rows.where((F.col("a") >= ratio * low - 1e-9) & (F.col("a") * ratio <= high + 1e-9))
    few = own.join(sized, "license")
    few = F.broadcast(few) if templates.count() <= MOST_TEMPLATES else few
    bound = (F.least("a", "b") >= ratio * F.greatest("a", "b") - 1e-9) & (F.col("x") == F.col("g"))
    hits = rows.select("id", "row", "kind", "segment_no", "a", F.explode("own").alias("x")).join(few, bound)
    shared = hits.groupBy("id", "row", "kind", "segment_no", "license").agg((2.0 * F.count("*") / (F.first("a") + F.first("b"))).alias("dice")).where(F.col("dice") >= least - 1e-9).alias("s")
    both = shared.join(times.alias("t"), F.col("s.id").eqNullSafe(F.col("t.id")) & (F.col("s.row") == F.col("t.row")), "left")
    dice = both.select("s.*", F.coalesce("t.times", F.lit(1)).alias("times")).withColumn("dice", F.col("dice") / F.col("times")).where(F.col("dice") >= least - 1e-9)
    best = dice.groupBy("id", "row", "kind", "segment_no").agg(F.max("dice").alias("dice"), F.first("times").alias("times"), F.collect_list(F.struct("dice", "license")).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda m: m["dice"] >= F.col("dice") - 1e-12), lambda m: m["license"]))
    best = best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return best.select(F.col("id").alias(id), "kind", F.col("segment_no").cast("long").alias("segment_no"), first.alias("license"), F.round("dice", 6).alias("dice"))
