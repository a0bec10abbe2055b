"""Licence scan: lines and blocks of a text against licence templates by Dice coefficient.

Everything is a projection of the row in DataFrame functions: nothing is shuffled and
the plan holds a fixed number of templates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILAR = 0.8

# Licence notices and the opening passages of licence texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class Template:
    licence: str
    pairs: tuple[str, ...]

    def bounds(self, similar: float) -> tuple[float, float]:
        """Pair counts beyond which the coefficient cannot reach ``similar``."""
        return len(self.pairs) * similar / (2 - similar), len(self.pairs) * (2 - similar) / similar


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    folded = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(folded, " "), "")


def pairs_of(words: Column) -> Column:
    """Word pairs in order; a single word stands alone."""
    after = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    joined = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), after, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, words).otherwise(joined)


def numbered(pairs: Column) -> Column:
    """Repeats of a pair get a number, so that set operations count them."""
    again = F.transform(
        pairs,
        lambda p, i: F.concat(p, F.repeat(F.lit("#"), F.size(F.filter(F.slice(pairs, 1, i), lambda q: q == p)))),
    )
    return F.when(F.size(F.array_distinct(pairs)) == F.size(pairs), pairs).otherwise(again)


def prepared(documents: DataFrame, templates=TEMPLATES) -> list[Template]:
    """Templates in the same normal form as the texts."""
    spark = documents.sparkSession
    rows = spark.createDataFrame(list(templates), "licence string, text string")
    ready = rows.select("licence", numbered(pairs_of(normal_words(F.col("text")))).alias("pairs")).collect()
    return [Template(r["licence"], tuple(r["pairs"])) for r in ready if r["pairs"]]


def licence_scan(documents: DataFrame, templates=TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, licence, dice, n_matches`` per input row.

    Compared are each line of a text and each block of two or more lines between blank
    lines. The coefficient is 2 |A and B| / (|A| + |B|) over word pairs, repeats counted.
    A text's licence is that of its best match of ``similar`` or more (equal ones: the
    first name); null with ``dice`` 0 if there is none, also for null and empty texts.
    ``n_matches`` counts lines and blocks with a match. Whole texts are read; repeated
    rows give repeated rows, other columns are ignored, no rows give none.
    """
    ready = prepared(documents, templates)
    listed = F.array(
        *[
            F.struct(
                F.lit(t.licence).alias("licence"),
                F.array(*map(F.lit, t.pairs)).alias("pairs"),
                *[F.lit(b).alias(n) for n, b in zip(("low", "high"), t.bounds(similar), strict=True)],
            )
            for t in ready
        ]
    )
    text = F.coalesce("text", F.lit(""))
    blocks = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda b: F.contains(b, F.lit("\n")))
    units = F.concat(F.split(text, "\n"), blocks)
    worded = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(units, normal_words).alias("units"))

    def fits(n: Column, template: Column) -> Column:
        return (n >= template["low"]) & (n <= template["high"])

    def size(words: Column) -> Column:
        return F.greatest(F.size(words) - 1, F.least(F.size(words), F.lit(1)))

    # Most units fit no template's size and are dropped before their pairs are built.
    fitting = worded.select("doc_id", F.filter("units", lambda w: F.exists(listed, lambda t: fits(size(w), t))).alias("units"))
    paired = fitting.select("doc_id", F.transform("units", lambda w: numbered(pairs_of(w))).alias("units"))

    def best(pairs: Column) -> Column:
        scored = F.transform(
            F.filter(listed, lambda t: fits(F.size(pairs), t)),
            lambda t: F.struct(
                (-2.0 * F.size(F.array_intersect(pairs, t["pairs"])) / (F.size(pairs) + F.size(t["pairs"]))).alias("down"),
                t["licence"].alias("licence"),
            ),
        )
        return F.array_min(scored)

    scored = paired.select("doc_id", F.filter(F.transform("units", best), lambda s: -s["down"] >= similar).alias("hits"))
    top = F.array_min("hits")
    return scored.select(
        "doc_id",
        top["licence"].alias("licence"),
        F.coalesce(-top["down"], F.lit(0.0)).alias("dice"),
        F.size("hits").cast("long").alias("n_matches"),
    )
