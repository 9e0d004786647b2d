"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates.

A passage is any run of words of a text. Its coefficient with a template is 2 c / (a + b), for a and b distinct bigrams
and c common ones, and a text's coefficient is that of its best passage. So a notice is found on a line of its own,
inside a line, wrapped over lines, with words put in or left out, or as the body of a whole licence.

All passages count, few are looked at. A coefficient of t needs b t / (2 - t) <= a <= b (2 - t) / t and therefore
c >= b t / (2 - t), so a text that holds fewer of the template's distinct bigrams has no such passage, whatever its
length. A best passage begins and ends with a bigram of the template that it holds just once, as it could be shortened
otherwise. So from each such bigram on, up to its next occurrence, a passage grows only by bigrams that are new to it:
a is how many there were, c how many of the template's, both running counts along one filtered array. It stops where the
text's own first occurrences alone are more than b (2 - t) / t. Summed up over the starts this is at most the template's
bigrams times the text's words.

Only DataFrame functions are used, without a shuffle: templates are a literal of the plan (their number is that
of the list given), and the best passage of a document is found inside its row.

Defined results: null and empty texts match nothing; of equal coefficients the template with the smaller name wins, and
inside one template the earliest passage; very long texts are read whole; repeated rows are scanned each; an empty table
gives an empty one; columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least coefficient that counts as a match.
MATCH = 0.75
#: Fixed texts: notices by which texts name their licence, and bodies of short licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause-body": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-body": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": "Released under the MIT License.",
    "mit-body": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; all else separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def words_in(text: str) -> list[str]:
    """The same for a template."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def marked(words: Column) -> Column:
    """Bigrams of a text by place: (i, prev, next, g), with the places of the same bigram before (-1: none) and after (null: none)."""
    grams = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    in_order = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    nothing = F.array(F.lit(None).cast("struct<g:string,i:int>"))
    n = F.size(words) - 1

    def neighbours(s: Column) -> Column:
        before, after = F.concat(nothing, F.slice(s, 1, n - 1)), F.concat(F.slice(s, 2, n - 1), nothing)
        with_before = F.zip_with(s, before, lambda x, y: F.struct(x.i.alias("i"), F.when(y.g == x.g, y.i).otherwise(-1).alias("prev"), x.g.alias("g")))
        return F.zip_with(with_before, after, lambda x, y: F.struct(x.i.alias("i"), x.prev.alias("prev"), F.when(y.g == x.g, y.i).alias("next"), x.g.alias("g")))

    # A lambda around the sorted array, so that it is sorted once.
    return F.when(n > 0, F.array_sort(F.transform(F.array(in_order), neighbours)[0]))


def best_passage(marks: Column, firsts: Column, grams: list[str], most: int) -> Column:
    """(dice, before): the greatest coefficient of a template over all passages, and minus the place where the first such one begins."""
    own, size = sorted(set(grams)), len(set(grams))

    def from_start(p: Column) -> Column:
        # Where p's bigram is the first of its kind, so many first occurrences further no passage is short enough.
        rank = F.array_position(firsts, p.i)
        end = F.least(F.coalesce(p.next, F.size(marks)), F.when(rank > 0, F.get(firsts, (rank + most - 1).cast("int"))), F.size(marks))
        new = F.filter(F.slice(marks, p.i + 1, end - p.i), lambda x: x.prev < p.i)
        counted = F.filter(F.transform(new, lambda x, k: F.struct(x.g.isin(own).alias("own"), (k + 1).alias("a"))), lambda x: x.own)
        return F.struct(F.array_max(F.transform(counted, lambda x, c: 2.0 * (c + 1) / (x.a + size))).alias("dice"), (-p.i).alias("before"))

    return F.array_max(F.transform(F.filter(marks, lambda x: x.g.isin(own)), from_start))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, match: float = MATCH) -> DataFrame:
    """One row per document: the best licence (null if none reaches ``match``), its coefficient, the first word of its passage, and how many licences match."""
    known = {name: bigrams(words_in(body)) for name, body in sorted((templates or TEMPLATES).items())}
    known = {name: grams for name, grams in known.items() if grams}
    all_grams = sorted({g for grams in known.values() for g in grams})
    first_words = sorted({g.split(" ")[0] for g in all_grams})
    least = match / (2 - match)
    out = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    # Bigrams of templates that the text holds: first places of their first words, so that few bigrams are put together.
    at = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s.w.isin(first_words))
    pairs = F.transform(at, lambda s: F.concat_ws(" ", s.w, F.get("words", s.i + 1)))
    out = out.select("doc_id", "words", F.array_distinct(F.filter(pairs, lambda g: g.isin(all_grams))).alias("held"))

    def enough(grams: list[str]) -> Column:
        own = sorted(set(grams))
        return F.size(F.filter("held", lambda g: g.isin(own))) >= least * len(own)

    # Templates that the text may match by the bounds; without one nothing else is computed.
    names = F.array_compact(F.array(*[F.when(enough(grams), F.lit(name)) for name, grams in known.items()])) if known else F.array().cast("array<string>")
    fewest = min((least * len(set(g)) for g in known.values()), default=1)
    out = out.select("doc_id", "words", F.when(F.size("held") >= fewest, names).alias("names"))
    out = out.select("doc_id", "names", F.when(F.size("names") > 0, marked(F.col("words"))).alias("marks"))
    firsts = F.transform(F.filter("marks", lambda x: x.prev < 0), lambda x: x.i)
    out = out.select("doc_id", "names", "marks", F.when(F.size("names") > 0, firsts).alias("firsts"))

    def best(name: str, grams: list[str]) -> Column:
        most = int(len(set(grams)) * (2 - match) / match)
        found = F.when(F.array_contains("names", name), F.transform(F.array(F.col("marks")), lambda m: best_passage(m, F.col("firsts"), grams, most))[0])
        return F.struct(found.dice.alias("dice"), (-found.before).alias("first_word"), F.lit(name).alias("license"))

    hits = F.filter(F.array(*[best(*k) for k in known.items()]), lambda h: h.dice >= match) if known else F.array().cast("array<struct<dice:double,first_word:int,license:string>>")
    out = out.select("doc_id", F.when(F.size("names") > 0, hits).alias("hits"))
    top = F.reduce("hits", F.element_at("hits", 1), lambda a, x: F.when(x.dice > a.dice, x).otherwise(a))
    top = F.when(F.size("hits") > 0, top)
    out = out.select("doc_id", top.alias("top"), F.greatest(F.size("hits"), F.lit(0)).cast("long").alias("n_licenses"))
    return out.select("doc_id", F.col("top.license").alias("license"), F.coalesce(F.round("top.dice", 6), F.lit(0.0)).alias("dice"), F.col("top.first_word").cast("long").alias("first_word"), "n_licenses")


def _sql() -> str:
    """Every passage from a bigram of the template on, to the end of the text; of texts that hold enough of its bigrams."""
    values = ", ".join(f"('{name}', {sorted(set(grams))!r})" for name, grams in ((n, bigrams(words_in(b))) for n, b in sorted(TEMPLATES.items())))
    return f"""
WITH t(name, own) AS (VALUES {values}),
og AS (SELECT name, len(own) AS b, unnest(own) AS g FROM t),
w AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
g AS (SELECT r, i - 1 AS i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM w)),
e AS (SELECT r, name, b FROM g JOIN og USING (g) GROUP BY ALL HAVING 2.0 * count(DISTINCT g) / (count(DISTINCT g) + b) >= {MATCH}),
m AS (SELECT g.*, coalesce(lag(i) OVER (PARTITION BY r, g ORDER BY i), -1) AS prev FROM g SEMI JOIN e USING (r)),
p AS (SELECT m.r, m.i, e.name, e.b FROM m JOIN e USING (r) JOIN og ON og.g = m.g AND og.name = e.name),
-- bigrams that are new to the passage from p on, with running counts of all and of the template's
x AS (SELECT p.r, p.name, p.b, p.i, count(*) OVER w AS a, count(og.g) OVER w AS c FROM p JOIN m ON m.r = p.r AND m.i >= p.i AND m.prev < p.i
  LEFT JOIN og ON og.g = m.g AND og.name = p.name WINDOW w AS (PARTITION BY p.r, p.name, p.i ORDER BY m.i)),
s AS (SELECT r, name, i, max(2.0::DOUBLE * c / (a + b)) AS dice FROM x GROUP BY ALL),
f AS (SELECT r, name, max(dice) AS dice, arg_min(i, (-dice, i)) AS first_word FROM s GROUP BY ALL HAVING max(dice) >= {MATCH}),
h AS (SELECT *, count(*) OVER (PARTITION BY r) AS n_licenses FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, name) = 1)
SELECT d.doc_id, name AS license, round(coalesce(dice, 0), 6) AS dice, first_word, coalesce(n_licenses, 0)::BIGINT AS n_licenses
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN h USING (r)
"""


ORACLE_SQL = _sql()
