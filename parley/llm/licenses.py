"""License scans: passages against licence templates by Dice coefficient over word bigrams."""

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.words import let

FLOOR = 0.8
#: Letters from which on a word of a template may stand for a bigram by itself.
RARE = 7

#: Wordings of public licence notices.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 "
                "as published by the Free Software Foundation.",),
    "BSD-3-Clause": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.",),
}


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct neighbouring word pairs of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                                       F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def _plain_bigrams(text: str) -> list[str]:
    import regex

    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def pivot_words(grams: list[str], floor: float) -> list[str]:
    """Words and word pairs of which every passage with a Dice of ``floor`` to a template has at least one; none where there is no such list.

    Of the template's T bigrams a match lacks at most T - T * floor / (2 - floor). Any words and
    pairs that stand in more bigrams than that can't all be missing: long words, as the rarer ones,
    are taken first, then long pairs, since a short word alone stands in most texts.
    """
    lacking = len(grams) - math.ceil(len(grams) * floor / (2 - floor) - 1e-9)
    by_length = sorted({w for g in grams for w in g.split() if len(w) >= RARE} | set(grams), key=lambda w: (" " in w, -len(w), w))
    covered, chosen = set(), []
    for pivot in by_length:
        if len(covered) > lacking:
            return chosen
        new = {g for g in grams if pivot == g or pivot in g.split()} - covered
        chosen += [pivot] if new else []
        covered |= new
    return chosen if len(covered) > lacking else []


def pivot_pattern(pivots: Iterable[str]) -> str:
    """One pattern for all pivots, those with the same first letter together."""
    by_letter: dict[str, list[str]] = {}
    for p in sorted(set(pivots)):
        by_letter.setdefault(p[0], []).append(p[1:].replace(" ", r"[^\p{L}\p{N}]+"))
    return "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())


def scan_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, floor: float = FLOOR,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of all passages: doc_id, passage (its place), license, template (its place), dice.

    Passages of a document are its lines, its paragraphs of several lines, and its whole text,
    each distinct one once. A passage of m bigrams can reach a Dice of ``floor`` only with
    templates of m * floor / (2 - floor) to m * (2 - floor) / floor bigrams; only those are
    compared. The templates are a short list given with the query, so they are literals in the
    plan: no join, no shuffle. Passages of fewer than two words have no bigrams and match nothing.
    Texts and passages without any of the templates' ``pivot_words`` can't match and are left before
    they are split. Null and empty texts give no rows, repeated rows give theirs each, other columns are ignored.
    """
    held = [(name, k, b) for name, texts in templates.items() for k, b in enumerate(map(_plain_bigrams, texts)) if b]
    if not held:
        held = [("", 0, [])]
    listed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(k).alias("template"), F.array(*map(F.lit, b)).cast("array<string>").alias("grams"))
                       for n, k, b in held])
    low = min(len(b) for _, _, b in held) * floor / (2 - floor)
    high = max(len(b) for _, _, b in held) * (2 - floor) / floor
    pivots = [pivot_words(b, floor) for _, _, b in held]
    pattern = pivot_pattern(w for p in pivots for w in p)

    def may_match(t: Column) -> Column:
        return F.lower(t).rlike(pattern) if all(pivots) else F.lit(True)

    docs = docs.filter(may_match(F.col(f"`{text_col}`")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n\s*"), lambda p: p.contains("\n"))
    passages = F.array_distinct(F.concat(F.split(text, "\n"), paragraphs, F.array(text)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(passages).alias("passage", "_t")).filter((F.length("_t") >= 3) & may_match(F.col("_t")))
    worded = rows.select("doc_id", "passage", normal_words(F.col("_t")).alias("_w")).filter(
        (F.size("_w") > low) & (F.size("_w") >= 2))
    sized = worded.select("doc_id", "passage", bigrams(F.col("_w")).alias("_g")).filter(F.size("_g").between(low, high))

    def score(g: Column) -> Column:
        m = F.size(g)
        near = F.filter(listed, lambda t: F.size(t["grams"]).between(m * floor / (2 - floor), m * (2 - floor) / floor))
        scored = F.transform(near, lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), (
            2.0 * F.size(F.array_intersect(g, t["grams"])) / (m + F.size(t["grams"]))).alias("dice")))
        return F.filter(scored, lambda s: s["dice"] >= floor)

    found = sized.select("doc_id", "passage", F.explode(let(F.col("_g"), score)).alias("_m"))
    return found.select("doc_id", "passage", "_m.license", "_m.template", "_m.dice")
