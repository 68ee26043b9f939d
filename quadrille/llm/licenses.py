"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

Each line of a text, and each whole text of several lines, is a unit; so is the run of
words, inside a line or across lines, that is nearest to a template. A unit is
normalised (lower case; runs of letters and digits are words), and its distinct word
bigrams are compared with those of each licence template:
``dice = 2 * shared / (bigrams of the unit + bigrams of the template)``.

Size bounds prune the templates of a unit before any bigram is built: a Dice coefficient
of at least ``t`` needs ``a / b`` within ``[t / (2 - t), (2 - t) / t]``. The number of
words bounds the number of distinct bigrams from above, so long units that cannot match
leave by counting alone where they are below a bound, and by their distinct bigrams where
they are above. Runs are sought only in texts with one of a few words (``anchors``) that
no match can lack all of, and for the templates of which the text has bigrams enough: a
match shares at least ``t / (2 - t)`` of the template's. The best run begins and ends with
a bigram of its template, so these are the only ends tried, up to ``(2 - t) / t`` times
the template's length. Templates are a constant table of this module, so they are literals of
the plan; nothing is broadcast and nothing is shuffled.

Defined results: null, empty and one-word units have no bigrams and match nothing. Of
equally good templates the smallest name wins, of equally good lines the first; a line
wins over the whole text, and both over a run. A text that matches as a whole has no runs.
A run that overlaps a matching line counts only if it holds that line and more: else it is
the notice that the line stands for. The best run left (first of equals) is one unit, if it
matches. ``oracle`` compares lines and whole texts only. Documents without a match have null licence, score and unit.
Repeated rows give a row each; other columns of the documents are left behind, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and
associated documentation files the software to deal in the software without restriction including without limitation
the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and
this permission notice shall be included in all copies or substantial portions of the software the software is provided
as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies the software is
provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance
with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
warranties or conditions of any kind either express or implied see the license for the specific language governing
permissions and limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general
public license as published by the free software foundation either version 3 of the license or at your option any later
version this program is distributed in the hope that it will be useful but without any warranty without even the implied
warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""

_LGPL = """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser
general public license as published by the free software foundation either version 3 of the license or at your option
any later version this library is distributed in the hope that it will be useful but without any warranty without even
the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license
for more details"""
_BSD_2 = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution"""
_BSD_3 = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = """this software is provided by the copyright holders and contributors as is and any express or implied warranties
including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special
exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
data or profits or business interruption however caused and on any theory of liability whether in contract strict
liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised
of the possibility of such damage"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
commercial or non commercial and by any means"""

#: (name, normalised template). Notices of one line come first, then whole grants.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", _APACHE),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_END}"),
    ("BSD-2-Clause", "licensed under the bsd 2 clause license"),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CC0-1.0", "released into the public domain under cc0 1 0"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", _GPL),
    ("ISC", _ISC),
    ("LGPL-3.0", "this work is licensed under the gnu lesser general public license version 3"),
    ("LGPL-3.0", _LGPL),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", _MIT),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("Proprietary", "all rights reserved"),
    ("Unlicense", _UNLICENSE),
]


def template_bigrams(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    found = []
    for name, text in templates:
        w = re.findall(r"[a-z0-9]+", text.lower())
        found.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return found


def anchors(templates: list[tuple[str, str]], low: float) -> list[str]:
    """Words of which every run with ``low`` of the bigrams of a template has at least one."""
    found = set()
    for _, b in template_bigrams(templates):
        left, need = {tuple(x.split()) for x in b}, max(1, math.ceil(len(b) * low - 1e-9))
        words = sorted({w for x in left for w in x})
        while len(left) >= need:
            best = max(words, key=lambda w: (any(w in x for x in left), min(len(w), 6), sum(w in x for x in left), w))
            found.add(best)
            left = {x for x in left if best not in x}
    return sorted(found)


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice, unit (line number from 0, -1 for the whole text, or -2 for a run),
    n_units (units within the size bounds of any template; a run counts if it matches), n_matches
    (units with a match)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    found = template_bigrams(templates)
    sizes = [len(b) for _, b in found]
    least, most = min(sizes) * low, max(sizes) * high
    # A string of runs of letters and digits, one blank between them: bigrams of a unit
    # cost nothing until its length in words has passed the lowest bound.
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("lines", F.expr(r"split(lower(coalesce(text, '')), '\n')"))
    d = d.withColumn("units", F.expr("if(size(lines) > 1, concat(transform(lines, (s, k) -> struct(k as k, s as s)), array(struct(-1 as k, lower(text) as s))), transform(lines, (s, k) -> struct(k as k, s as s)))"))
    # An n-bigram unit has at least 2 n + 1 characters; a shorter line is not split.
    shortest = int(2 * least)
    d = d.withColumn("units", F.expr(f"transform(filter(units, u -> length(u.s) > {shortest}), u -> struct(u.k as k, regexp_extract_all(u.s, '[a-z0-9]+', 0) as w))"))
    d = d.withColumn("units", F.expr(f"filter(units, u -> size(u.w) > {least - 1e-9!r})"))
    d = d.withColumn("units", F.expr("transform(units, u -> struct(u.k as k, array_distinct(transform(slice(u.w, 2, greatest(size(u.w) - 1, 0)), (x, p) -> concat(u.w[p], ' ', x))) as b))"))
    d = d.withColumn("units", F.expr(f"filter(units, u -> size(u.b) between {least - 1e-9!r} and {most + 1e-9!r})"))
    scores = []
    for name, b in found:
        n = len(b)
        arr = "array(" + ", ".join(map(_sql_text, b)) + ")"
        scores.append(f"struct(if(size(u.b) between {n * low - 1e-9!r} and {n * high + 1e-9!r}, 2D * size(array_intersect(u.b, {arr})) / (size(u.b) + {n}), 0D) as dice, {_sql_text(name)} as license)")
    best = "aggregate(array(" + ", ".join(scores) + "), struct(0D as dice, '' as license), (x, y) -> if(y.dice > x.dice or (y.dice = x.dice and y.dice > 0D and y.license < x.license), y, x))"
    d = d.withColumn("scored", F.expr(f"transform(units, u -> struct(u.k as k, {best} as best))"))
    d = d.withColumn("hits", F.expr(f"filter(scored, x -> x.best.dice >= {threshold - 1e-12!r})"))
    d = _with_run(d, threshold, templates)
    order = "(x, y) -> if(x.k is null or y.best.dice > x.best.dice, y, x)"
    d = d.withColumn("hits", F.expr("if(run is null, hits, concat(hits, array(struct(-2 as k, struct(run.dice as dice, run.license as license) as best))))"))
    d = d.withColumn("top", F.expr(f"aggregate(hits, cast(null as struct<k:int,best:struct<dice:double,license:string>>), {order})"))
    n_units = (F.size("units") + F.col("run").isNotNull().cast("int")).cast("long")
    made = F.struct(F.col("top.best.license").alias("license"), F.col("top.best.dice").alias("dice"), F.col("top.k").cast("long").alias("unit"), n_units.alias("n_units"), F.size("hits").cast("long").alias("n_matches"))
    # A filter on the result does not pass a generator, so that it cannot repeat all of the above.
    return d.select("doc_id", F.inline(F.array(made)))


def _with_run(d: DataFrame, threshold: float, templates: list[tuple[str, str]]) -> DataFrame:
    """``d`` with ``run``: dice and license of the best run of words that matches, or null."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    table = []
    for (name, b), (_, text) in sorted(zip(template_bigrams(templates), templates, strict=True), key=lambda x: x[0][0]):
        most = int((len(re.findall(r"[a-z0-9]+", text.lower())) - 1) * high + 1e-9)
        table.append(f"struct({_sql_text(name)} as license, {max(1, math.ceil(len(b) * low - 1e-9))} as need, {most} as most, array({', '.join(map(_sql_text, b))}) as b)")
    every = ", ".join(map(_sql_text, sorted({x for _, b in template_bigrams(templates) for x in b})))
    words = anchors(templates, low)
    # Short words are parts of many others, so these are compared as whole words.
    maybe = [f"contains(low, {_sql_text(w)})" for w in words if len(w) > 4]
    if short := "|".join(w for w in words if len(w) <= 4):
        maybe.append(f"low rlike {_sql_text(f'(?<![a-z0-9])(?:{short})(?![a-z0-9])')}")
    maybe = " or ".join(maybe)
    d = d.withColumn("low", F.expr("lower(coalesce(text, ''))"))
    d = d.withColumn("maybe", F.expr(f"({maybe}) and not exists(hits, x -> x.k = -1)"))
    # Words by line, their bigrams over line ends, and the first and last word of matching lines.
    d = d.withColumn("by_line", F.expr("if(maybe, transform(lines, s -> regexp_extract_all(s, '[a-z0-9]+', 0)), array())"))
    d = d.withColumn("w", F.expr("flatten(by_line)"))
    d = d.withColumn("seq", F.expr("if(size(w) > 1, transform(slice(w, 2, size(w) - 1), (x, p) -> concat(w[p], ' ', x)), array())"))
    d = d.withColumn("known", F.expr(f"array_intersect(seq, array({every}))"))
    d = d.withColumn("near", F.expr(f"if(size(known) = 0, array(), filter(array({', '.join(table)}), t -> size(array_intersect(known, t.b)) >= t.need))"))
    d = d.withColumn("taken", F.expr("if(size(near) = 0, array(), transform(hits, x -> struct(aggregate(slice(by_line, 1, x.k), 0, (n, l) -> n + size(l)) as a, aggregate(slice(by_line, 1, x.k + 1), -1, (n, l) -> n + size(l)) as z)))"))
    d = d.withColumn("near", F.expr("transform(near, t -> struct(t as t, filter(transform(seq, (x, p) -> if(array_contains(t.b, x), p, -1)), p -> p >= 0) as pos))"))
    # A run goes from word i to word j + 1. Of one start, the first of the best ends is kept.
    ends = "filter(slice(n.pos, r + 1, n.t.most), (j, q) -> j - i < n.t.most and q + 1 >= n.t.need and not exists(taken, x -> i <= x.z and j + 1 >= x.a and not (i <= x.a and j + 1 >= x.z and j + 1 - i > x.z - x.a)))"
    score = "transform(array(array_distinct(slice(seq, i + 1, j - i + 1))), b -> 2D * size(array_intersect(b, n.t.b)) / (size(b) + size(n.t.b)))[0]"
    best = f"coalesce(array_max(transform({ends}, j -> {score})), 0D)"
    d = d.withColumn("runs", F.expr(f"flatten(transform(near, n -> transform(n.pos, (i, r) -> struct({best} as dice, n.t.license as license))))"))
    return d.withColumn("run", F.expr(f"aggregate(runs, cast(null as struct<dice:double,license:string>), (x, y) -> if(y.dice >= {threshold - 1e-12!r} and (x is null or y.dice > x.dice), y, x))"))


def oracle(threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same result in DuckDB SQL."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    values = ", ".join(f"('{name}', [{', '.join(repr(x) for x in b)}])" for name, b in template_bigrams(templates))
    return rf"""
WITH t(license, tb) AS (VALUES {values}),
lines AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS l, lower(text) AS whole FROM documents),
units AS (
  SELECT r, unnest(range(len(l))) AS unit, unnest(l) AS s FROM lines
  UNION ALL SELECT r, -1, whole FROM lines WHERE len(l) > 1),
word AS (SELECT r, unit, regexp_extract_all(s, '[a-z0-9]+') AS w FROM units),
bigram AS (SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS b FROM word WHERE len(w) > 1),
inside AS (SELECT * FROM bigram WHERE len(b) >= (SELECT min(len(tb)) FROM t) * {low!r} - 1e-9 AND len(b) <= (SELECT max(len(tb)) FROM t) * {high!r} + 1e-9),
scored AS (SELECT r, unit, license, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
  FROM inside, t WHERE len(b) BETWEEN len(tb) * {low!r} - 1e-9 AND len(tb) * {high!r} + 1e-9),
best AS (SELECT r, unit, license, dice FROM scored WHERE dice >= {threshold!r} - 1e-12
  QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY dice DESC, license) = 1),
top AS (SELECT r, license, dice, unit, count(*) OVER (PARTITION BY r) AS n FROM best
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, CASE WHEN unit = -1 THEN 1e18 ELSE unit END) = 1)
SELECT d.doc_id, top.license, top.dice, CAST(top.unit AS BIGINT) AS unit,
  CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(top.n, 0) AS BIGINT) AS n_matches
FROM lines d LEFT JOIN top USING (r) LEFT JOIN (SELECT r, count(*) AS n_units FROM inside GROUP BY r) u USING (r)
"""
