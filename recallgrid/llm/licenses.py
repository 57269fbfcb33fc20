"""License scan in DataFrame functions only.

Texts are normalised to lower-case words; each line is a set of word bigrams, compared with each
template's by the Dice coefficient. Statements that are wrapped are found by windows of words that
reach over an end of line, of at most as many bigrams as the template's threshold allows; a window
begins and ends with a bigram of the template, as others only lower the coefficient. A template
is only compared where the sizes of the two sets allow the threshold, and a set that no template's
size allows isn't compared at all. Sets are only made of lines that hold, for some template, a word of each of
two lists: without a word of a list the template has too few bigrams left to reach the threshold. Texts are
only cut into lines if they hold bigrams of a template in the same way, as whole words.

n_lines counts the lines that state a licence alone, 0 where only windows over several lines do; dice
is that of the best line, or of the best window where no line does.

Defined results: null and empty texts have no lines and give no rows; a tie between templates of one
text gives a row for each; repeated rows are counted together by doc_id (a null one too); a text of any length
is compared whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm.common import documents, stage

DICE = 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Licence statements and short licence texts, as published.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
}


def bigrams(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _allowed(n: int) -> tuple[int, int]:
    """Sizes m with 2 min(n, m) / (n + m) >= DICE."""
    sizes = [m for m in range(1, 20 * n) if 2 * min(n, m) >= DICE * (n + m)]
    return min(sizes), max(sizes)


def anchors(own: list[str], other: tuple[str, ...] = ()) -> list[str]:
    """Words, none of them in other, of which a line must hold one (anywhere) to reach DICE with the bigrams; [] if there are none."""
    chosen: list[str] = []
    left = own
    while len(left) >= DICE * (len(own) + _allowed(len(own))[0]) / 2:
        words = sorted({w for b in left for w in b.split()} - set(other))
        if not words:
            return []
        chosen.append(max(words, key=lambda w: sum(w in b for b in left) * len(w) ** 3))
        left = [b for b in left if chosen[-1] not in b]
    return chosen


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, UPPER.lower()), "[^a-z0-9]+"), lambda w: w != "")


def _stated(sets: list[tuple[str, list[str]]], text: Column) -> Column:
    """Whether the text holds so many bigrams of a template as any line or window of it needs.

    What reaches DICE shares the smallest allowed set with the template: it must hold one of any n - low + 1
    of the template's n bigrams, so one of each such list.
    """
    lists = []
    for _, own in sets:
        k, long = len(own) - _allowed(len(own))[0] + 1, sorted(own, key=lambda b: (-len(b), b))
        lists.append([long[a : a + k] for a in range(0, len(own) - k + 1, k)])

    def holds(t: Column) -> Column:
        return reduce(or_, [reduce(and_, [reduce(or_, [F.contains(t, F.lit(f" {b} ")) for b in bs]) for bs in of]) for of in lists])

    spaced = F.concat(F.lit(" "), F.regexp_replace(F.translate(text, UPPER, UPPER.lower()), "[^a-z0-9]+", " "), F.lit(" "))
    return F.exists(F.array(spaced), holds)


def wrapped(texts: DataFrame, sets: list[tuple[str, list[str]]]) -> DataFrame:
    """doc_id, license, wdice: windows over several lines that reach DICE; texts has doc_id and text."""
    texts = texts.filter(F.contains(F.col("text"), F.lit("\n")))
    places = F.flatten(F.transform(F.split("text", "\n", -1), lambda t, i: F.transform(_words(t), lambda w: F.struct(w.alias("w"), i.alias("i")))))
    t = texts.select("doc_id", places.alias("w"))
    size = F.greatest(F.size("w") - 1, F.lit(0))
    pair = lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("g"), a["i"].alias("i"), b["i"].alias("j"))
    t = t.select("doc_id", F.zip_with(F.slice("w", 1, size), F.slice("w", 2, size), pair).alias("g"))
    t = t.filter(F.element_at("g", -1)["j"] > F.get("g", F.lit(0))["i"]).withColumn("s", F.array_distinct(F.col("g")["g"]))
    named = [F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, own)).alias("own"), F.lit(_allowed(len(own))[0]).alias("low"), F.lit(_allowed(len(own))[1]).alias("high")) for name, own in sets]
    t = t.select("doc_id", "g", F.inline(F.filter(F.array(*named), lambda x: F.size(F.array_intersect("s", x["own"])) >= x["low"])))
    begins = F.filter(F.sequence(F.lit(1), F.size("g")), lambda k: F.array_contains("own", F.element_at("g", k)["g"]))
    reach = F.filter(F.transform(begins, lambda k: F.slice("g", k, F.col("high"))), lambda x: F.element_at(x, -1)["j"] > F.element_at(x, 1)["i"])
    x = t.select("doc_id", "license", "own", F.explode(reach).alias("x"))
    ends = F.filter(F.sequence(F.lit(1), F.size("x")), lambda k: (F.element_at("x", k)["j"] > F.element_at("x", 1)["i"]) & F.array_contains("own", F.element_at("x", k)["g"]))
    part = lambda k: F.slice(F.col("x")["g"], 1, k)
    best = F.array_max(F.transform(ends, lambda k: 2 * F.size(F.array_intersect(part(k), F.col("own"))) / (F.size(F.array_distinct(part(k))) + F.size("own"))))
    return x.select("doc_id", "license", best.alias("wdice")).filter(F.col("wdice") >= DICE)


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, n_lines, dice: the licences that a text states, with the best coefficient."""
    sets = [(name, bigrams(t)) for name, ts in (templates or TEMPLATES).items() for t in ts]
    bounds = [_allowed(len(b)) for _, b in sets]
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
    first = [anchors(b) for _, b in sets]
    needed = {(tuple(a), tuple(anchors(b, tuple(a)))) for a, (_, b) in zip(first, sets)}

    def anchored(text: Column) -> Column:
        def holds(t: Column) -> Column:
            return reduce(or_, [reduce(and_, [reduce(or_, [F.contains(t, F.lit(w)) for w in ws]) for ws in lists if ws] or [F.lit(True)]) for lists in sorted(needed)])

        return F.exists(F.array(F.lower(text)), holds)

    # the few texts that may state a licence are read twice, all texts once; bigrams are only sought in those with anchor words
    texts = stage(docs.filter(anchored(F.col("text")) & _stated(sets, F.col("text"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "anchored")
    lines = texts.select("doc_id", F.explode(F.filter(F.split("text", "\n", -1), anchored)).alias("line"))
    # a bound before any set is made: a bigram takes a space and, with it, at least a letter
    lines = lines.filter(F.length("line") >= 2 * low)
    lines = lines.select("doc_id", _words(F.col("line")).alias("w"))
    size = F.greatest(F.size("w") - 1, F.lit(0))
    pairs: Column = F.array_distinct(F.zip_with(F.slice("w", 1, size), F.slice("w", 2, size), lambda a, b: F.concat_ws(" ", a, b)))
    lines = lines.withColumn("b", pairs).withColumn("n", F.size("b")).filter(F.col("n").between(low, high))

    def dice(i: int) -> Column:
        own = sets[i][1]
        shared = F.size(F.array_intersect("b", F.array(*map(F.lit, own))))
        return F.when(F.col("n").between(*bounds[i]), 2 * shared / (F.col("n") + len(own))).otherwise(0.0)

    lines = lines.select("doc_id", F.inline(F.array(*[F.struct(F.lit(name).alias("license"), dice(i).alias("dice")) for i, (name, _) in enumerate(sets)])))
    found = lines.filter(F.col("dice") >= DICE).unionByName(wrapped(texts, sets), allowMissingColumns=True)
    return found.groupBy("doc_id", "license").agg(F.count("dice").alias("n_lines"), F.round(F.coalesce(F.max("dice"), F.max("wdice")), 6).alias("dice"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP3_SQL = f"""
WITH t(license, b, low, high) AS (VALUES {", ".join(f"({_quoted(name)}, [{', '.join(map(_quoted, bigrams(t)))}], {_allowed(len(bigrams(t)))[0]}, {_allowed(len(bigrams(t)))[1]})" for name, ts in TEMPLATES.items() for t in ts)}),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM l),
g AS (SELECT doc_id, list_distinct([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) AS b FROM w WHERE len(w) >= 2),
d AS (SELECT doc_id, license, 2 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice FROM g, t),
ln AS (SELECT doc_id, license, count(*) AS n_lines, max(dice) AS dice FROM d WHERE dice >= {DICE} GROUP BY 1, 2),
s AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS p FROM (SELECT doc_id, i, unnest(w) AS x, unnest(range(len(w))) AS k FROM w)),
b AS (SELECT * FROM (SELECT doc_id, p, i, x || ' ' || lead(x) OVER o AS g, lead(i) OVER o AS j FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE g IS NOT NULL),
h AS (SELECT b.doc_id, p, i, j, license, own, high FROM b JOIN (SELECT license, b AS own, high, unnest(b) AS g FROM t) USING (g)),
z AS (SELECT a.doc_id, a.license, a.own, a.p AS p1, e.p AS p2 FROM h a JOIN h e ON a.doc_id = e.doc_id AND a.license = e.license AND a.own = e.own AND e.p >= a.p AND e.p < a.p + a.high AND e.j > a.i),
v AS (SELECT z.doc_id, license, 2 * count(DISTINCT g) FILTER (list_contains(own, g)) / (count(DISTINCT g) + len(own)) AS wdice FROM z JOIN b ON b.doc_id = z.doc_id AND b.p BETWEEN p1 AND p2 GROUP BY z.doc_id, license, own, p1, p2),
wr AS (SELECT doc_id, license, max(wdice) AS wdice FROM v WHERE wdice >= {DICE} GROUP BY 1, 2)
SELECT doc_id, license, coalesce(n_lines, 0) AS n_lines, round(coalesce(dice, wdice), 6) AS dice FROM ln FULL JOIN wr USING (doc_id, license)
"""
