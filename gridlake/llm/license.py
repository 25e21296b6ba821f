"""Licence scans: Dice coefficient of word bigrams against licence templates, with DataFrame functions only.

A text is cut into units: its lines, and its paragraphs (runs of lines without a blank one between) of several lines.
A unit is lower-cased, everything but letters and digits becomes a blank, and its distinct word bigrams are taken.
With d bigrams in the unit and n in a template, a Dice coefficient of at least t needs
n * t / (2 - t) <= d <= n * (2 - t) / t, so other templates are pruned before any bigram is compared. A unit gets the
best template at or above the threshold (the first listed of equals).

A notice may also stand in a unit with other words: behind them on its line, or hard-wrapped, with or without comment
marks, in a longer paragraph. So where no unit matched, windows of each template's length in words, across lines, are
compared too; a window starts at a bigram of its template. Of windows that overlap the best one counts (of equals the
longer, then the first listed). A text, and a unit of it, is looked at only if it holds a word that each match must hold,
and a text is cut into windows only for templates of whose bigrams it has enough: both follow from the threshold, and
nothing that matches is lost by them.

All of it is done within the row: no shuffle, and one source or one long text does not gather rows.

Defined results: null or empty text matches nothing (n_matches 0, licenses '', best_dice 0); null and repeated ids
are kept, one result a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Threshold in percent.
PERCENT = 80

# Notices as the public licences word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]


def template_bigrams(text: str) -> list[str]:
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a unit."""
    words = F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def units(text: Column) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(lines, paragraphs)


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


#: Words of all kinds of text: a text is asked for them last.
COMMON = frozenset("a an and any as at but by for in is it no not of on or that the this to under use with you".split())


def needed_words(templates: list[list[str]], percent: int) -> list[str]:
    """Words of which a text must hold one to reach the threshold with any template. A match has at least
    n * percent / (200 - percent) of a template's n bigrams, so at least one of any set of more than the others."""
    out = set()
    for b in templates:
        spare = len(b) - -(-len(b) * percent // (200 - percent)) + 1
        left = set(b)
        for w in sorted({w for g in b for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(b) - len(left) >= spare:
                break
            out.add(w)
            left = {g for g in left if w not in g.split()}
    return sorted(out)


def _any_of(words: list[str]) -> str:
    """A pattern for whole words, by their first letters."""
    starts: dict[str, list[str]] = {}
    for w in words:
        starts.setdefault(w[0], []).append(w[1:])
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'{x}(?:{"|".join(rest)})' for x, rest in starts.items())})(?![\p{{L}}\p{{N}}])"


def _sequence(text: Column) -> Column:
    """All word bigrams of a text, in order."""
    return _let(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x00]+", " ")), " "), lambda w: F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))


def _windows(seq: Column, known: Column, percent: int) -> Column:
    """The windows that match, none of which overlap: at, to, dice, first, name."""

    def of(t: Column, b: Column) -> Column:
        starts = F.filter(F.transform(b, lambda g, i: F.when(F.array_contains(t["bigrams"], g), i)), lambda i: i.isNotNull())
        scored = F.transform(starts, lambda i: _let(F.array_distinct(F.slice(b, i + 1, t["size"])), lambda w: F.struct(
            (F.size(F.array_intersect(w, t["bigrams"])) * -2.0 / (F.size(w) + t["n"])).alias("order"), (-t["size"]).alias("less"), (-t["first"]).alias("nr"), i.alias("at"),
            (i + t["size"] + 1).alias("to"), t["name"].alias("name"))))
        return F.filter(scored, lambda x: x["order"] * -100 >= percent)

    def near(b: Column) -> Column:
        return _let(F.array_distinct(b), lambda d: F.filter(known, lambda t: F.size(F.array_intersect(d, t["bigrams"])) * (200 - percent) >= t["n"] * percent))

    found = _let(seq, lambda b: F.array_sort(F.flatten(F.transform(near(b), lambda t: of(t, b)))))
    kept = _let(found, lambda all_: F.aggregate(all_, F.filter(all_, lambda x: F.lit(False)), lambda acc, x: F.when(
        F.exists(acc, lambda y: (y["at"] < x["to"]) & (x["at"] < y["to"])), acc).otherwise(F.array_append(acc, x))))
    return F.transform(kept, lambda x: F.struct((-x["order"]).alias("dice"), (-x["nr"]).alias("first"), x["name"].alias("name")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_matches (units and windows with a licence), licenses (names, sorted, by comma), best_dice."""
    rows = [(name, template_bigrams(t), len(words(t)) - 1) for name, t in (templates or TEMPLATES)]
    known = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(-i).alias("first"), F.lit(len(b)).alias("n"), F.lit(size).alias("size"), F.array(*map(F.lit, b)).alias("bigrams"))
        for i, (name, b, size) in enumerate(rows)))
    small = -(-min(len(b) for _, b, _ in rows) * percent // (200 - percent))
    # a unit of fewer than small + 1 words (one blank or mark between two at least) can't match any template
    body = F.coalesce(F.col(text_col), F.lit(""))
    needed = _any_of(needed_words([b for _, b, _ in rows], percent))
    may = F.lower(body).rlike(needed)
    long_enough = F.filter(units(body), lambda u: (F.length(u) >= 2 * small + 1) & F.lower(u).rlike(needed))

    def best(b: Column) -> Column:
        d = F.size(b)
        near = F.filter(known, lambda t: (d * (200 - percent) >= t["n"] * percent) & (d * percent <= t["n"] * (200 - percent)))
        scored = F.transform(near, lambda t: F.struct((F.size(F.array_intersect(b, t["bigrams"])) * 2.0 / (d + t["n"])).alias("dice"), t["first"].alias("first"), t["name"].alias("name")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] * 100 >= percent))

    hits = F.filter(F.transform(F.transform(long_enough, bigrams), best), lambda x: x.isNotNull())

    # units that matched give way to a mark that no template has
    mark = F.lit(" \x00 ")
    hit = lambda u: (F.length(u) >= 2 * small + 1) & F.lower(u).rlike(needed) & _let(bigrams(u), best).isNotNull()
    lines = lambda p: F.array_join(F.transform(F.split(p, "\n"), lambda u: F.when(hit(u), mark).otherwise(u)), "\n")
    rest = F.array_join(F.transform(F.split(F.replace(body, F.lit("\x00"), F.lit(" ")), r"\n\s*\n"), lambda p: F.when(F.contains(p, F.lit("\n")) & hit(p), mark).otherwise(lines(p))), "\n")
    found = F.concat(hits, _windows(_sequence(rest), known, percent))
    hits = F.when(may, found).otherwise(F.array().cast("array<struct<dice:double,first:int,name:string>>"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), hits.alias("hits")).select(
        "doc_id", F.size("hits").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("hits.name"))), ",").alias("licenses"),
        F.coalesce(F.round(F.array_max(F.col("hits.dice")), 6), F.lit(0.0)).alias("best_dice"))


def oracle(percent: int = PERCENT) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quote(n)}, {i}, [{', '.join(map(quote, template_bigrams(t)))}])" for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(name, nr, grams)),
u AS (
  SELECT doc_id, rid, unit FROM (
    SELECT doc_id, rid, unnest(list_concat(string_split(body, chr(10)), list_filter(regexp_split_to_array(body, '\\n\\s*\\n'), lambda p: contains(p, chr(10))))) AS unit
    FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body FROM documents))),
w AS (SELECT doc_id, rid, row_number() OVER () AS uid, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u),
g AS (SELECT rid, uid, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
s AS (
  SELECT g.rid, g.uid, t.name, t.nr, len(list_intersect(g.grams, t.grams)) * 2.0::DOUBLE / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON len(g.grams) * {200 - percent} >= len(t.grams) * {percent} AND len(g.grams) * {percent} <= len(t.grams) * {200 - percent}),
b AS (SELECT rid, uid, arg_min(name, (-dice, nr)) AS name, max(dice) AS dice FROM s WHERE dice * 100 >= {percent} GROUP BY rid, uid),
r AS (SELECT rid, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS dice FROM b GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licenses, coalesce(round(dice, 6), 0)::DOUBLE AS best_dice
FROM (SELECT doc_id, row_number() OVER () AS rid FROM documents) d LEFT JOIN r USING (rid)"""
