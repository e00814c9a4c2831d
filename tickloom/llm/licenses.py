"""License scans: lines, paragraphs, whole texts and windows of words against licence templates by the Dice coefficient.

A unit and a template are compared as sets of word bigrams of their normalised text. The two
sizes bound the coefficient, so most units never meet most templates. All of it is one SQL
expression on each row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rules import _through

#: Least Dice coefficient of a match, in percent.
PERCENT = 80

#: Licence notices and grants, as their public texts have them (fixed values).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a normalised text: A-Z lowered, what is no a-z or 0-9 as one space."""
    words = "".join(c if c in "0123456789" + _LOWER else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.translate(unit, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """The distinct bigrams of two words or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def _may_match(words: Column, distinct: Column, templates: dict[str, str], percent: int) -> Column:
    """Whether a unit can match any template, told from its words alone.

    Each distinct word but one ends a bigram of its own, so a unit has at least that many bigrams,
    and at least as many that no template has as it has words that no template has. Of the
    bigrams of a match, (2 - 2 d) / (2 - d) at most are not the template's, d being the Dice coefficient.
    """
    sizes = [bounds(len(bigrams(t)), percent) for t in templates.values()]
    known = sorted({w for t in templates.values() for g in bigrams(t) for w in g.split()})
    foreign = F.size(distinct) - F.size(F.array_intersect(distinct, F.array(*map(F.lit, known))))
    return (F.size(words) > min(a for a, _ in sizes)) & (F.size(distinct) - 1 <= max(b for _, b in sizes)) & ((200 - percent) * (foreign - 1) <= (200 - 2 * percent) * (F.size(words) - 1))


def bounds(size: int, percent: int) -> tuple[int, int]:
    """The least and the most bigrams that a unit can have to match a template of this many."""
    return -(-percent * size // (200 - percent)), (200 - percent) * size // percent


def telling(templates: dict[str, str], percent: int) -> list[tuple[str, ...]]:
    """Words, and pairs of short ones, of which every text that matches a template has at least one (or both of a pair).

    A text without a template's chosen words lacks more of its bigrams than a match may. Long words
    that several templates have are taken first; a word found inside a longer one counts as found.
    """
    own = {n: bigrams(t) for n, t in templates.items()}
    inside = lambda w, g: any(w in v for v in g.split())
    uses = {w: sum(any(inside(w, g) for g in grams) for grams in own.values()) for w in {w for grams in own.values() for g in grams for w in g.split()}}
    out: dict[tuple[str, ...], None] = {}
    for grams in own.values():
        missing = len(grams) - bounds(len(grams), percent)[0]
        lost: set[str] = set()
        long = sorted({w for g in grams for w in g.split() if len(w) >= 6}, key=lambda w: (-uses[w], -len(w), w))
        for term in [*((w,) for w in long), *(tuple(g.split()) for g in sorted(grams, key=lambda g: (-len(g), g)))]:
            mine = {g for g in grams if (inside(term[0], g) if len(term) == 1 else g.split() == list(term))} - lost
            if mine and len(lost) <= missing:
                out[term] = None
                lost |= mine
    return list(out)


def _gate(text: Column, templates: dict[str, str], percent: int) -> Column:
    """Whether a text can match any template, told by searches for words, without taking the text apart.

    It has one of the telling words, and for some template both words of as many bigrams as a match has.
    """
    def any_of(low: Column) -> Column:
        found = lambda words: reduce(and_, (F.contains(low, F.lit(w)) for w in words))
        enough = F.lit(False)
        for t in templates.values():
            own = bigrams(t)
            enough = enough | (sum((found(g.split()).cast("int") for g in own), F.lit(0)) >= bounds(len(own), percent)[0])
        return F.when(reduce(or_, map(found, telling(templates, percent))), enough).otherwise(False)

    return _through(F.lower(text), any_of)


def _matches(grams: Column, templates: dict[str, str], percent: int) -> Column:
    """(license, common, total) of the templates that a unit's bigrams match, as an array."""
    out = []
    for name, text in templates.items():
        own = bigrams(text)
        least, most = bounds(len(own), percent)
        common = F.size(F.array_intersect(grams, F.array(*map(F.lit, own))))
        found = F.struct(F.lit(name).alias("license"), common.alias("common"), (F.size(grams) + len(own)).alias("total"))
        out.append(F.when(F.size(grams).between(least, most), found))
    return F.filter(F.array(*out), lambda m: m.isNotNull() & (200 * m["common"] >= percent * m["total"]))


def _embedded(words: Column, found: Column, templates: dict[str, str], percent: int) -> Column:
    """(license, common, total) of the best window of words for each template that is not in found, as an array.

    A window begins and ends with a bigram of the template and has at most as many more as its
    bounds allow. A match has at least `least` distinct bigrams of the template, and a word that
    is missing takes one of them at least, two words being in each; so few texts get any further.
    """
    sizes = {n: (len(bigrams(t)), *bounds(len(bigrams(t)), percent)) for n, t in templates.items()}
    lit = lambda values: F.split(F.lit("\n".join(sorted(values))), "\n")
    own = {n: set(bigrams(t)) for n, t in templates.items()}
    terms = {n: {w for g in own[n] for w in g.split()} for n in templates}
    names = F.transform(found, lambda m: m["license"])
    none = F.expr("cast(array() as array<struct<license: string, common: int, total: int>>)")

    def best(name: str, grams: Column, at: Column) -> Column:
        size, least, most = sizes[name]
        n_all = len("".join(c if c.isascii() and c.isalnum() else " " for c in templates[name]).split()) - 1
        longest = most + n_all - size

        def window(a: Column, b: Column) -> Column:
            def judged(g: Column) -> Column:
                common, total = F.size(F.array_intersect(g, lit(own[name]))), F.size(g) + size
                return F.struct((2.0 * common / total).alias("dice"), F.lit(name).alias("license"), common.alias("common"), total.alias("total"))

            return _through(F.array_distinct(F.slice(grams, a + 1, b - a + 1)), judged)

        starts = F.filter(F.sequence(F.lit(0), F.size(at) - least), lambda i: F.get(at, i + (least - 1)) - F.get(at, i) < longest)
        ends = lambda i: F.filter(F.sequence(i + (least - 1), F.least(F.size(at) - 1, i + (longest - 1))), lambda j: F.get(at, j) - F.get(at, i) < longest)
        windows = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: window(F.get(at, i), F.get(at, j)))))
        top = F.array_max(F.filter(windows, lambda m: 200 * m["common"] >= percent * m["total"]))
        return F.when(F.size(windows) > 0, top)

    def of_grams(grams: Column) -> Column:
        def of_known(known: Column) -> Column:
            out = []
            for n in templates:
                at = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(lit(own[n]), F.get(grams, i)))  # noqa: B023
                fits = ~F.array_contains(names, n) & (F.size(F.array_intersect(known, lit(own[n]))) >= sizes[n][1])
                out.append(F.when(fits, _through(at, lambda h: best(n, grams, h))))  # noqa: B023
            some = F.filter(F.array(*out), lambda m: m.isNotNull())
            return F.transform(some, lambda m: F.struct(m["license"].alias("license"), m["common"].alias("common"), m["total"].alias("total")))

        return _through(F.array_intersect(grams, lit(set().union(*own.values()))), of_known)

    def rough(known: Column) -> Column:
        out = F.lit(False)
        for n in templates:
            out = out | (F.size(F.array_intersect(known, lit(terms[n]))) >= len(terms[n]) - 2 * (sizes[n][0] - sizes[n][1]))
        return out

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    may = (F.size(words) > 1) & _through(F.array_intersect(words, lit(set().union(*terms.values()))), rough)
    return F.when(may, _through(grams, of_grams)).otherwise(none)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """docs with licenses: an array of (license, common, total), one for each matching unit and template.

    Units are the distinct lines, paragraphs (parted by blank lines) and the whole text. Dice is
    2 * common / total. A template that no unit matches is sought in windows of consecutive words as well,
    across lines and signs, and its best window counts once. A null or empty text, or one of less than two words, matches nothing.
    Repeated rows are treated alike; other columns stay, save one named licenses, in any case.
    """
    if min(len(bigrams(t)) for t in templates.values()) == 0:
        raise ValueError("a template needs two words")
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "licenses"])
    text = F.coalesce("text", F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t]*\n"), F.array(text)))
    none = F.expr("cast(array() as array<struct<license: string, common: int, total: int>>)")

    def of_words(w: Column) -> Column:
        fits = _through(F.array_distinct(w), lambda v: _may_match(w, v, templates, percent))
        return F.when(fits, _through(_bigrams(w), lambda g: _matches(g, templates, percent))).otherwise(none)

    found = F.flatten(F.transform(units, lambda u: _through(_words(u), of_words)))
    whole = _through(found, lambda f: _through(_words(text), lambda w: F.concat(f, _embedded(w, f, templates, percent))))
    return docs.withColumn("licenses", F.when(_gate(text, templates, percent), F.array_sort(whole)).otherwise(none))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names, comma-joined) and dice (the best, to 6 digits; 0 without a match)."""
    dice = F.transform("licenses", lambda m: 2.0 * m["common"] / m["total"])
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_distinct(F.transform("licenses", lambda m: m["license"])), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(dice), F.lit(0.0)), 6).alias("dice"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: licences of all documents."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _template_rows() -> str:
    return ", ".join("('{}', [{}])".format(n, ", ".join(f"'{g}'" for g in bigrams(t))) for n, t in TEMPLATES.items())


ORACLE_SQL = rf"""
WITH t(license, own) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t]*\n'), [text]))) AS unit FROM d),
w AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(translate(unit, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, license, len(list_intersect(g, own)) AS common, len(g) + len(own) AS total FROM g, t WHERE {PERCENT} * len(g) <= (200 - {PERCENT}) * len(own) AND {PERCENT} * len(own) <= (200 - {PERCENT}) * len(g)),
f AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(2.0 * common / total) AS dice FROM m WHERE 200 * common >= {PERCENT} * total GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licenses, round(coalesce(dice, 0.0), 6)::DOUBLE AS dice
FROM d LEFT JOIN f USING (doc_id)
"""
