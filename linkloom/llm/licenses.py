"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text's units are its lines, its paragraphs and the whole text, normalised to
lower-case words.  A unit is compared with a template only where the sizes
allow it: with thresholds t, sets of a and b bigrams can reach it only if
t / (2 - t) <= a / b <= (2 - t) / t, so both the unit's word count and then its
distinct bigrams prune templates before any intersection is taken.

Notices wrapped over lines, or amid other words, are found by windows: for a
template that no unit matches, every run of as many words as it has that
begins with one of its bigrams is compared, and the best counts.  Only texts
with at least t / (2 - t) of its bigrams are looked at so.

Everything is one projection of built-in functions: no shuffle, no UDF; the
templates are a literal of fixed size.

Defined results: null and empty texts match nothing; a unit of one word has no
bigrams and matches nothing; equal scores go to the first name in order; an own
column with the result's name stays, the result then gets an underscore before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Names and wordings of licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Frequent words of English that tell no licence.
COMMON = frozenset("a all an and any are as at be been both but by can do either for from has have he her his if in into is it its later may no not of on one only or other our out she so some such than that the their them then there these they this those to under up use used v was we were what when which who will with without work works you your".split())
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.sub(r"[^\w]+|_", " ", text.lower()).split(" ") if w]


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _literal(templates: list[tuple[str, str]]) -> Column:
    sets = [(name, len(words_of(text)), bigrams_of(text)) for name, text in templates]
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(w).alias("w"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("set")) for i, (name, w, b) in enumerate(sets)))


def _scored(b: Column, t: Column) -> Column:
    dice = F.lit(2.0) * F.size(F.array_intersect(b, t["set"])) / (F.size(b) + t["n"])
    return F.struct(dice.alias("dice"), t["name"].alias("name"), t["i"].alias("i"))


def _pairs(words: Column) -> Column:
    """Bigrams of at least two words, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))


def _matches(unit_words: Column, threshold: float, templates: list[tuple[str, str]]) -> Column:
    """array<struct<dice, name, i>> of the templates that a unit's words match."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    literal = _literal(templates)

    def against(b: Column) -> Column:
        fits = F.filter(literal, lambda t: (F.size(b) >= t["n"] * F.lit(low) - 1e-9) & (F.size(b) <= t["n"] * F.lit(high) + 1e-9))
        return F.filter(F.transform(fits, lambda t: _scored(b, t)), lambda s: s["dice"] >= threshold)

    return F.flatten(F.transform(F.array(F.array_distinct(_pairs(unit_words))), against))


def _windows(words: Column, matched: Column, threshold: float, templates: list[tuple[str, str]]) -> Column:
    """array<struct<dice, name, i>>: the best window of each template that is not among matched."""
    union = F.array(*map(F.lit, sorted({b for _, text in templates for b in bigrams_of(text)})))
    least = F.lit(threshold / (2 - threshold))

    def of(b: Column) -> Column:
        def best(t: Column, at: Column) -> Column:
            own = F.filter(at, lambda i: F.array_contains(t["set"], F.element_at(b, i)))
            scored = F.transform(own, lambda i: _scored(F.array_distinct(F.slice(b, i, t["w"] - 1)), t))
            return F.array_max(F.when(F.size(own) >= t["n"] * least - 1e-9, F.filter(scored, lambda s: s["dice"] >= threshold)))

        def among(at: Column) -> Column:
            todo = F.filter(_literal(templates), lambda t: ~F.exists(matched, lambda s: s["i"] == t["i"]))
            found = F.filter(F.transform(todo, lambda t: best(t, at)), lambda s: s.isNotNull())
            return F.when(F.size(at) > 0, found)

        places = F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: F.array_contains(union, F.element_at(b, i)))
        return F.transform(F.array(places), among)[0]

    return F.transform(F.array(_pairs(words)), of)[0]


def _telling(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which any matching unit holds at least one: a match shares at
    least threshold / (2 - threshold) of a template's bigrams, so words that
    make up no more of its bigrams than that can be left out."""
    found: set[str] = set()
    for _, text in templates:
        pairs = [b.split(" ") for b in bigrams_of(text)]
        empty = [p for p in pairs if set(p) <= COMMON]
        found |= {w for p in pairs for w in p if w not in COMMON or len(empty) >= threshold / (2 - threshold) * len(pairs) - 1e-9}
    return sorted(found)


def scan(df: DataFrame, text_col: str = "text", threshold: float = 0.8, templates: list[tuple[str, str]] | None = None, out: str = "licenses") -> DataFrame:
    """df with array<struct<dice, name>>: the templates that units match, each score once."""
    templates = TEMPLATES if templates is None else templates
    sizes = [len(bigrams_of(t)) for _, t in templates]
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    none = F.array().cast("array<struct<dice:double,name:string,i:int>>")
    telling = F.array(*map(F.lit, _telling(templates, threshold)))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    paragraphs = F.filter(F.split(text, "\n\n+"), lambda p: F.contains(p, F.lit("\n")))
    words = lambda u: F.filter(F.split(F.lower(u), NOT_WORD), lambda w: w != "")

    def of_unit(w: Column) -> Column:
        # w distinct words make at least w - 1 distinct bigrams; those of a part bound the whole from below
        fits = (F.size(w) > least - 1e-9) & F.arrays_overlap(w, telling) & (F.size(F.array_distinct(F.slice(w, 1, int(4 * most) + 4))) <= most + 1 + 1e-9)
        return F.when(fits, _matches(w, threshold, templates)).otherwise(none)

    def of_text(lined: Column) -> Column:
        # one-element arrays bind a value to a name, so that it is computed once; the whole text's words are its lines'
        def with_words(whole: Column) -> Column:
            units = F.concat(lined, F.array(whole), F.transform(paragraphs, words))
            found = F.flatten(F.transform(units, of_unit))
            more = lambda m: F.concat(m, F.coalesce(F.when((F.size(whole) > 1) & F.arrays_overlap(whole, telling), _windows(whole, m, threshold, templates)), none))
            return F.transform(F.array(found), more)[0]

        return F.transform(F.array(F.flatten(lined)), with_words)[0]

    found = F.transform(F.array(F.transform(F.split(text, "\n"), words)), of_text)[0]
    (name,) = fresh(df, out)
    return df.withColumn(name, F.array_distinct(F.transform(found, lambda s: F.struct(s["dice"].alias("dice"), s["name"].alias("name")))))


def report(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document: number of matches, best name and score, all names."""
    found = scan(documents.select(documents["doc_id"].cast("long"), documents["text"]), threshold=threshold)
    best = F.element_at(F.array_sort(F.transform("licenses", lambda x: F.struct((-x["dice"]).alias("d"), x["name"].alias("n")))), 1)
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.when(F.size("licenses") > 0, best["n"]).alias("best"), F.when(F.size("licenses") > 0, F.round(-best["d"], 6)).alias("best_dice"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"]))), ",").alias("names"))


def oracle(threshold: float = 0.8) -> str:
    """DuckDB SQL for report()."""
    rows = ", ".join(f"({i}, '{name}', {len(words_of(text))}, [{', '.join(repr(b) for b in bigrams_of(text))}])" for i, (name, text) in enumerate(TEMPLATES))
    norm = r"list_filter(string_split(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH templates(i, name, words, pairs) AS (VALUES {rows}),
units AS (SELECT DISTINCT doc_id, u FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS u FROM documents
  UNION ALL SELECT doc_id, coalesce(text, '') FROM documents
  UNION ALL SELECT doc_id, p FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n\n+')) AS p FROM documents) WHERE contains(p, chr(10)))),
worded AS (SELECT doc_id, {norm} AS w FROM units),
paired AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM worded WHERE len(w) > 1),
scored AS (SELECT doc_id, i, name, 2.0::DOUBLE * len(list_intersect(b, pairs)) / (len(b) + len(pairs)) AS dice FROM paired, templates WHERE len(b) BETWEEN 0.6 * len(pairs) AND 1.6 * len(pairs)),
of_units AS (SELECT * FROM scored WHERE dice >= {threshold}),
whole AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM (SELECT doc_id, {norm} AS w FROM (SELECT doc_id, coalesce(text, '') AS u FROM documents))),
starts AS (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS s FROM whole),
windows AS (SELECT doc_id, i, name, pairs, list_distinct(list_slice(b, s, s + words - 2)) AS b FROM starts, templates WHERE list_contains(pairs, b[s])),
of_windows AS (SELECT doc_id, i, name, max(2.0::DOUBLE * len(list_intersect(b, pairs)) / (len(b) + len(pairs))) AS dice FROM windows GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id, name, dice FROM (SELECT * FROM of_units UNION ALL SELECT * FROM of_windows w WHERE dice >= {threshold} AND NOT EXISTS (SELECT 1 FROM of_units u WHERE u.doc_id = w.doc_id AND u.i = w.i))),
best AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, first(name ORDER BY dice DESC, name) AS best, round(max(dice), 6) AS best_dice FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, best, best_dice, coalesce(names, '') AS names FROM documents d LEFT JOIN best USING (doc_id)"""
