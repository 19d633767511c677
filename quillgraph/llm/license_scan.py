"""Licence scanning: parts of texts against licence templates by the Dice coefficient over word bigrams.

Words are lower-case runs of letters and digits. Dice is 2 |A and B| / (|A| + |B|) over the distinct bigrams. Two sizes can reach a
coefficient t only if each is at least t / (2 - t) of the other, so templates out of these bounds are passed over. A unit that matches holds
at least that share of the template's bigrams; so of each template one bigram more than may be missing is picked, rare ones first. Texts and
lines that lack both words of all picked bigrams, and units without a picked bigram, are passed over before any other bigram is made.

Units are lines, their sentences, paragraphs of several lines (up to a line without a letter or digit), sentences that go over a line end,
and whole texts. Besides, of each template all windows of as many words as it has are looked at that hold a picked bigram of it, wherever they
stand in a text and however it is wrapped; for each licence the window that matches best (of equals the first template's, then the last in
order of text) is a unit as well.

Only DataFrame functions, no shuffle. Nulls: null and empty texts have no units; null ids are kept; repeated rows are each reported; an
empty table gives an empty table. A unit's best template counts; on a tie the first one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Slack of the size bounds, so that rounding passes over no unit that reaches the threshold exactly.
SLACK = 1e-9
COMMON = frozenset("a an and any are as be by for from in is it may of on or that the this to with you not no without use form terms work program project released".split())


def none() -> Column:
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Template:
    k: int
    name: str
    words: list[str]
    grams: list[str]
    #: The bigrams of which a match holds one at least.
    picked: list[str]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def picked(words: list[str], least: float = LEAST) -> list[tuple[str, str]]:
    """Bigrams of which a unit that reaches `least` holds at least one: one more than it may miss, those of rarer words first."""
    grams = [tuple(g.split()) for g in bigrams_of(words)]
    may_miss = int(len(grams) * (1 - least / (2 - least)) + SLACK)
    often = Counter(w for g in grams for w in g)
    weight = lambda w: (w in COMMON, len(w) < 4, len(w) == 1)
    return sorted(grams, key=lambda g: (min(map(weight, g)), max(map(weight, g)), -often[g[0]] - often[g[1]], g))[: may_miss + 1]


def by_rare_word(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """The rarer word of each pair -> the words it stands beside."""
    out: dict[str, set[str]] = {}
    for a, b in pairs:
        rare, other = sorted((a, b), key=lambda w: (w in COMMON, -len(w), w))
        out.setdefault(rare, set()).add(other)
    return {w: sorted(o) for w, o in sorted(out.items())}


def holds_words(text: Column, beside: dict[str, list[str]]) -> Column:
    """Whether a lower-case text has both words of some pair anywhere."""
    return reduce(or_, [F.contains(text, F.lit(w)) & reduce(or_, [F.contains(text, F.lit(x)) for x in others]) for w, others in beside.items()])


def holds_pairs(unit: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whether a normal form has some pair as neighbours."""
    padded = F.concat(F.lit(" "), unit, F.lit(" "))
    return reduce(or_, [F.contains(padded, F.lit(f" {a} {b} ")) for a, b in pairs])


def normal(low: Column) -> Column:
    """Words of a lower-case text with single spaces between them."""
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.when(F.size(w) < 2, none()).otherwise(F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))


def dice_of(g: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(g, b)) / (F.size(g) + F.size(b))


def windows(w: Column, forms: list[Template], least: float) -> Column:
    """For each licence the text of the window that matches one of its templates best, if one reaches `least`. w: the words of a text.

    Windows of one text that are equal are compared once, so a notice that a text repeats costs what one does.
    """
    pair = lambda p: F.concat(F.get(w, p), F.lit(" "), F.get(w, p + 1))
    places = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda p: pair(p).isin(sorted({x for f in forms for x in f.picked})))

    def best(hits: Column, own: list[Template]) -> Column:
        return F.array_max(F.concat(*[candidates(hits, f) for f in own]))["unit"]

    def candidates(hits: Column, f: Template) -> Column:
        m, held = len(f.words), F.array(*map(F.lit, f.grams))
        own = F.filter(hits, lambda p: pair(p).isin(f.picked))
        around = F.array_distinct(F.transform(own, lambda p: F.array_join(F.slice(w, F.greatest(p - (m - 2), F.lit(0)) + 1, F.least(p, F.lit(m - 2)) + m), " ")))
        cut = lambda a: F.when(F.size(a) >= m, F.transform(F.sequence(F.lit(1), F.size(a) - m + 1), lambda s: F.array_join(F.slice(a, s, m), " "))).otherwise(none())
        units = F.array_distinct(F.flatten(F.flatten(F.transform(around, lambda c: F.transform(F.array(F.split(c, " ")), cut)))))
        scored = F.transform(units, lambda u: F.struct(dice_of(bigrams(F.split(u, " ")), held).alias("dice"), F.lit(-f.k).alias("k"), u.alias("unit")))
        return F.filter(scored, lambda x: x["dice"] >= least)

    by_name: dict[str, list[Template]] = {}
    for f in forms:
        by_name.setdefault(f.name, []).append(f)
    bound = F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, F.array_compact(F.array(*[best(h, own) for own in by_name.values()]))).otherwise(none()))
    return F.flatten(bound)


def matches(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, unit (its normal form), licence, dice: each text's distinct units that reach `least`."""
    forms = [Template(k, name, w := words_of(text), bigrams_of(w), [" ".join(p) for p in picked(w, least)]) for k, (name, text) in enumerate(templates)]
    low = min(len(f.grams) for f in forms) * least / (2 - least) - SLACK
    high = max(len(f.grams) for f in forms) * (2 - least) / least + SLACK
    pairs = sorted({tuple(x.split()) for f in forms for x in f.picked})
    beside = by_rare_word(pairs)
    # behind explode, a text is lowered once and the tests on it aren't pushed below that
    texts = docs.select(F.col(id_col).alias("i"), F.explode(F.array(F.lower(text_col))).alias("t")).where(F.col("t").isNotNull() & holds_words(F.col("t"), beside))
    lines = F.filter(F.array_distinct(F.split("t", "\n")), lambda u: holds_words(u, beside))
    parts = F.flatten(F.transform(lines, lambda u: F.concat(F.array(u), F.split(F.regexp_replace(u, r"([.!?])\s+", "$1\n"), "\n"))))
    wrapped = F.filter(F.split("t", r"\n(?:[^\p{L}\p{N}\n]*(?:\n|$))+"), lambda u: F.contains(u, F.lit("\n")) & holds_words(u, beside))
    over = F.flatten(F.transform(wrapped, lambda u: F.concat(F.array(u), F.split(u, r"(?<=[.!?])(?=\s)"))))
    over = F.filter(over, lambda u: F.contains(F.btrim(u, F.lit(" \t\r\n")), F.lit("\n")))
    whole = F.when(F.contains("t", F.lit("\n")), F.array("t")).otherwise(none())
    found = F.filter(F.array_distinct(F.transform(F.concat(parts, over, whole), normal)), lambda u: holds_pairs(u, pairs))
    texts = texts.select("i", found.alias("found"), F.explode(F.array(normal(F.col("t")))).alias("n")).where(holds_pairs(F.col("n"), pairs))
    texts = texts.select("i", "found", F.explode(F.array(F.split("n", " "))).alias("w"))
    units = texts.select("i", F.explode(F.array_distinct(F.concat("found", windows(F.col("w"), forms, least)))).alias("unit"))
    units = units.select("i", "unit", bigrams(F.split("unit", " ")).alias("g")).where((F.size("g") >= low) & (F.size("g") <= high))
    held = F.array(*[F.struct(F.lit(f.k).alias("k"), F.lit(f.name).alias("licence"), F.array(*map(F.lit, f.grams)).alias("b")) for f in forms])
    ratio = F.lit(least / (2 - least) - SLACK)
    near = F.filter(held, lambda t: (F.size("g") >= ratio * F.size(t["b"])) & (F.size(t["b"]) >= ratio * F.size("g")))
    dice = F.transform(near, lambda t: F.struct(dice_of(F.col("g"), t["b"]).alias("dice"), (-t["k"]).alias("k"), t["licence"].alias("licence")))
    best = units.select("i", "unit", F.array_max(dice).alias("m")).where(F.col("m.dice") >= least)
    return best.select(F.col("i").alias(id_col), "unit", F.col("m.licence").alias("licence"), F.round("m.dice", 6).alias("dice"))


def oracle(templates=TEMPLATES, least: float = LEAST) -> str:
    """The same rows by DuckDB, but for units over line ends that aren't windows; without the tests that pass units over."""
    rows = ", ".join("({}, {}, {}, [{}])".format(k, "'" + name + "'", len(words_of(text)), ", ".join(f"'{g}'" for g in bigrams_of(words_of(text)))) for k, (name, text) in enumerate(templates))
    form = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""
WITH t(k, licence, m, b) AS (VALUES {rows}),
own AS (SELECT doc_id, text, row_number() OVER () AS rn FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, rn, unnest(string_split(text, chr(10))) AS line FROM own),
ws AS (SELECT doc_id, rn, string_split({form.format("text")}, ' ') AS w FROM own),
gs AS (SELECT doc_id, rn, generate_subscripts(w, 1) AS i, unnest(list_transform(range(1, len(w) + 1), lambda j: w[j] || ' ' || w[j + 1])) AS g, len(w) AS n FROM ws),
tb AS (SELECT k, licence, m, len(b) AS nb, unnest(b) AS g FROM t),
hits AS (SELECT doc_id, rn, k, licence, m, nb, g, unnest(range(greatest(1, i - m + 2), least(i, n - m + 1) + 1)) AS s FROM gs JOIN tb USING (g) WHERE i < n),
near AS (SELECT doc_id, rn, k, licence, m, nb, s, count(DISTINCT g) AS shared FROM hits GROUP BY ALL HAVING shared >= nb * {least} / (2 - {least}) - 0.001),
win AS (SELECT near.doc_id, near.rn, k, licence, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(s, s + m - 1)]) AS g, shared, nb, array_to_string(w[s:s + m - 1], ' ') AS u FROM near JOIN ws USING (rn)),
best AS (SELECT doc_id, rn, arg_max(u, (2.0 * shared / (len(g) + nb), -k, u)) AS u FROM win WHERE 2.0 * shared / (len(g) + nb) >= {least} GROUP BY doc_id, rn, licence),
units AS (
  SELECT doc_id, rn, line AS u FROM lines
  UNION ALL SELECT doc_id, rn, unnest(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) FROM lines
  UNION ALL SELECT doc_id, rn, text FROM own WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, rn, u FROM best),
n AS (SELECT DISTINCT doc_id, rn, {form.format("u")} AS unit FROM units),
g AS (SELECT doc_id, rn, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM (SELECT *, string_split(unit, ' ') AS w FROM n WHERE unit <> '') WHERE len(w) >= 2),
d AS (SELECT doc_id, rn, unit, k, licence, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, t WHERE len(g) BETWEEN len(b) * {least} / (2 - {least}) - 0.001 AND len(b) * (2 - {least}) / {least} + 0.001)
SELECT doc_id, unit, arg_max(licence, (dice, -k)) AS licence, round(max(dice), 6) AS dice FROM d WHERE dice >= {least} GROUP BY doc_id, rn, unit
"""
