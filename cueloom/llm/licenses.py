"""Licence texts found by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# Notices and texts of well-known licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "This project is licensed under the terms of the MIT license.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
        OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _telling(grams: list[str], least: float, ratio: float) -> set[str]:
    """Words of which every passage similar enough to a template has one.

    Such a passage shares so many bigrams with the template that it can only miss a few; these words are in more than
    that. Long words are taken first, as they are rarer in other texts.
    """
    n = len(grams)
    missed = n - math.ceil(least * (n + n * ratio) / 2 - 1e-9)
    words, covered = set(), set()
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
        if len(covered) > missed:
            break
        words.add(word)
        covered |= {g for g in grams if word in g.split()}
    return words


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The best licence of every document and how many of its passages carry one.

    Passages are the lines, the blocks between blank lines and the whole text, each with letters A-Z lowered and runs
    of other characters than a-z and 0-9 read as one space. A template is compared only with passages whose number of
    distinct bigrams can reach the coefficient at all; a passage that no template can match is not taken apart.

    Returns doc_id, license (null if none), dice and n_passages. Null and empty texts have no passages and no licence;
    equal coefficients go to the licence whose name comes first. Rows are independent, so repeated rows and null ids
    keep their rows; other columns are not read. Nothing is shuffled.
    """
    grams = {name: _bigrams(t) for name, t in sorted(templates.items())}
    ratio = least / (2 - least)
    fewest = max(1, math.ceil(min(map(len, grams.values())) * ratio))
    most = math.floor(max(map(len, grams.values())) / ratio)
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.array(*[F.lit(x) for x in g]).alias("grams")) for name, g in grams.items()
    ])
    plain = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    words = sorted(set().union(*[_telling(g, least, ratio) for g in grams.values()]))
    told = F.rlike("plain", F.lit(rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("plain", r"[^a-z0-9\n]+", " "), r" ?\n ?", "\n"), r"\n\n+", "\r")
    # Blocks end in \r, lines in \n or \r; a unit's words are counted before its bigrams are built.
    lines = F.split("clean", r"[\n\r]")
    blocks = F.transform(F.split("clean", "\r"), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
    whole = F.array(F.translate("clean", "\n\r", "  "))
    units = F.transform(F.array_distinct(F.concat(lines, blocks, whole)), lambda x: F.split(F.trim(x), " "))
    # Every distinct bigram needs a word more; repeated bigrams only lower the number, so only the lower bound cuts here.
    units = F.filter(units, lambda w: F.size(w) > fewest)

    def pairs(words: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))

    sized = F.filter(F.transform(units, pairs), lambda g: F.size(g).between(fewest, most))

    def best(own: Column) -> Column:
        n = F.size(own)
        fit = F.filter(table, lambda t: (t["n"] >= n * F.lit(ratio)) & (t["n"] <= n / F.lit(ratio)))
        scored = F.transform(fit, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(own, t["grams"])) / (n + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.filter(scored, lambda s: s["dice"] >= least)

    none = F.expr("CAST(array() AS array<array<struct<dice:double,name:string>>>)")
    top = F.aggregate(
        F.flatten("hits"), F.expr("CAST(NULL AS struct<dice:double,name:string>)"),
        lambda a, b: F.when(a.isNull() | (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["name"] < a["name"])), b).otherwise(a))
    # A text without a telling word has no passage that is similar enough, so only the others are taken apart.
    scored = (
        docs.select(F.col(doc_id).alias("doc_id"), plain.alias("plain"))
        .select("doc_id", F.when(told, clean).alias("clean"))
        .select("doc_id", F.when(F.col("clean").isNotNull(), F.transform(sized, best)).otherwise(none).alias("hits"))
    )
    return scored.select(
        "doc_id", top.alias("top"), F.size(F.filter("hits", lambda h: F.size(h) > 0)).cast("long").alias("n_passages"),
    ).select("doc_id", F.col("top.name").alias("license"), F.col("top.dice").alias("dice"), "n_passages")
