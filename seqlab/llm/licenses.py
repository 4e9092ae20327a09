"""License scans: MinHash bands over text windows, then exact containment (operator 9), with DataFrame functions only.

Words are runs of letters and digits of the lower-cased text; shingles are five
words.  Templates are license notices.  For every template length there is a
window length: windows start at every ``step``-th word and are long enough to
hold a whole occurrence wherever it starts, so an occurrence with at least 0.8
of a template's shingles has a Jaccard similarity of at least 0.5 to a window
that holds it.  A window retrieves a template when they agree in one of
``BANDS`` MinHash bands (of one value each): at 0.5, all bands miss with
probability 2 ** -BANDS.  What is retrieved counts only if the window holds
at least ``containment`` of the template's distinct shingles.

A window is hashed only where it holds a marker: one of a few words of the
templates, chosen so that more than 1 - containment of each template's
shingles hold a marker.  A window without a marker can therefore never
verify; nothing is lost.  Documents without any marker are not even cut.

Everything happens in the row: no shuffle and no keys, so hot sources and
copies cost what other rows cost.  Null, empty and blank texts have no
licenses.  Repeated rows get equal results; columns not kept are ignored.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
BANDS = 20

#: Fixed texts of well-known license notices: (license, notice).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _words(notice: str) -> list[str]:
    return re.findall(r"[^\W_]+", notice.lower())


def _shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def markers(notices: list[tuple[str, str]], containment: float) -> list[str]:
    """Words (longest first) such that over 1 - containment of every notice's shingles hold one of them."""
    chosen: list[str] = []
    for _, notice in notices:
        words = _words(notice)
        if len(words) < SHINGLE:
            raise ValueError(f"a notice needs {SHINGLE} words: {notice}")
        shingles = _shingles(words)
        for w in sorted(set(words), key=lambda x: (-len(x), x)):
            bare = sum(not any(c in s for c in chosen) for s in shingles)
            if bare < containment * len(shingles) and any(c in words for c in chosen):
                break
            if w not in chosen:
                chosen.append(w)
    return sorted(chosen)


def window_plan(notice: str) -> tuple[int, int]:
    """(words in a window, words between window starts) for a notice."""
    n = len(_words(notice))
    size = SHINGLE  # lengths are rounded up to a ladder of ratio 1.25, so notices share windows
    while size < n:
        size = math.ceil(size * 1.25)
    step = max(1, size // 8)
    return size + step - 1, step


def _grams(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(
        F.array_join(F.slice(words, i, SHINGLE), " ")))).otherwise(F.array().cast("array<bigint>"))


def _bands(grams: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.xxhash64(
        j, F.array_min(F.transform(grams, lambda g: F.xxhash64(g, j)))))


def _templates(spark: SparkSession, notices: list[tuple[str, str]]) -> list:
    """(license, plan, shingles, bands) of every notice, by the same expressions as the texts."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, _words(n))).alias("w")) for i, (_, n) in enumerate(notices)])
    df = spark.range(1).select(F.explode(rows).alias("t")).select("t.i", F.array_distinct(_grams(F.col("t.w"))).alias("g"))
    found = df.select("i", "g", _bands(F.col("g")).alias("b")).collect()  # one row for each notice
    return [(notices[r["i"]][0], window_plan(notices[r["i"]][1]), r["g"], r["b"]) for r in sorted(found)]


def _verified(size: int, step: int, templates: Column, containment: float) -> Column:
    """(word, license, share) of the windows of one plan that hold a marker and verify."""
    starts = F.array_distinct(F.flatten(F.transform("marked", lambda p: F.transform(
        F.sequence(F.greatest(F.ceil((p - size + 1) / step), F.lit(0)).cast("int"), F.floor(p / step).cast("int")),
        lambda q: q * step))))
    windows = F.transform(starts, lambda q: F.struct(
        q.alias("word"), F.slice("grams", q + 1, size - SHINGLE + 1).alias("grams")))
    windows = F.transform(F.filter(windows, lambda w: F.size(w["grams"]) > 0), lambda w: F.struct(
        w["word"].alias("word"), w["grams"].alias("grams"), _bands(w["grams"]).alias("bands")))

    def share(w, t):
        return F.size(F.array_intersect(t["grams"], w["grams"])) / F.size(t["grams"])

    return F.flatten(F.transform(windows, lambda w: F.transform(
        F.filter(templates, lambda t: F.arrays_overlap(t["bands"], w["bands"]) & (share(w, t) >= containment)),
        lambda t: F.struct(w["word"].alias("word"), t["license"].alias("license"), share(w, t).alias("share")))))


def find_licenses(documents: DataFrame, keep: list[str], containment: float = 0.8, text: str = "text",
                  notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """The kept columns with ``matches``: (license, word, share) of verified windows, by word, license.

    ``word`` is the number of the first word of the window, from 0; ``share``
    the share of the notice's shingles that it holds.  Of overlapping windows
    all that verify are listed.
    """
    marks = markers(notices, containment)
    plans: dict[tuple[int, int], list] = {}
    for name, plan, grams, bands in _templates(documents.sparkSession, notices):
        plans.setdefault(plan, []).append(F.struct(
            F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"), F.array(*map(F.lit, bands)).alias("bands")))
    keep = [c for c in keep if c != "matches"]
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    empty = F.array().cast("array<string>")
    df = documents.select(F.struct(*keep).alias("row"), F.when(lower.rlike("|".join(marks)), F.regexp_extract_all(
        lower, F.lit(WORD), F.lit(0))).otherwise(empty).alias("words"))
    at = F.transform("words", lambda w, i: F.when(w.isin(marks), i))
    df = df.withColumn("marked", F.filter(at, lambda i: i.isNotNull()))
    df = df.withColumn("grams", F.when(F.size("marked") > 0, _grams(F.col("words"))).otherwise(F.array().cast("array<bigint>")))
    parts = [_verified(size, step, F.array(*templates), containment) for (size, step), templates in
             sorted(plans.items(), key=lambda x: x[0])]
    return df.select("row.*", F.array_sort(F.concat(*parts)).alias("matches"))
