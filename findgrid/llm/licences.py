"""Licence scan: a trained paragraph classifier over sparse word n-grams, calibrated, confirmed by templates.

train() fits a multinomial logistic regression on the driver: classes are the licence families of TEMPLATES and `unknown`.
Its examples are the templates with words left out or put around them, decoys, and a sample of at most `negatives`
paragraphs of the corpus. A proximal step keeps the weights sparse; a temperature found on held-out examples calibrates
the probabilities. scan() is DataFrame code only: paragraphs are runs of lines with a letter or digit (so comment marks alone
part them). Each line is classified, and so are paragraphs of several lines as a whole, in overlapping stretches of words, as
statements are wrapped. Paragraphs and lines that hold no n-gram which speaks for a family can't be anything but unknown, and
are left out by one regular expression before their n-grams are joined with the weights (a table as small as the templates).
The best family is confirmed if a line or stretch has most words of one of its templates.

Null and empty texts have no paragraph. Repeated rows are each scanned and give equal rows; an empty table gives no rows. Very
long texts are read whole: each paragraph in stretches. Families of equal score go by name. The input's other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Short statements of each family, and the sentences that notices of it consist of.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License.", "Unless required by applicable law or agreed to in writing, software distributed under the Apache License is distributed on an AS IS basis.", "SPDX-License-Identifier: Apache-2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software under the GNU GPL v3 or any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-2.0": ["Licensed under the GNU General Public License, version 2.", "This program is free software under the GNU GPL v2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl": ["Licensed under the GNU Lesser General Public License.", "This library is free software under the LGPL.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, all copyright and related rights are waived under CC0 1.0.", "This work is dedicated to the public domain."],
    "proprietary": ["All rights reserved.", "Copyright holder. All rights reserved.", "No part may be reproduced without prior written permission of the copyright holder."],
}
#: Paragraphs that share words with licences and are none.
DECOYS = (
    "He lost his driving license on the way.", "The public library opens at nine.", "A version of the story was told.",
    "Permission to leave was granted to the person.", "The general public was free to use the terms.", "Software and source code are different things.",
    "All rights and wrongs of the work.", "The commons were open under the law.", "It is not permitted to use this file.", "The Apache people live in the south.",
    "Mit der und die mit, das ist.", "Nicht mit den, mit dem.", "Mit.",
)
TOKEN = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
NEGATIVES = 2000
LEAST = 0.6  # calibrated probability of a family
CONFIRM = 0.7  # share of a template's words
#: Words of a stretch of a wrapped paragraph, and from one to the next.
STRETCH, STEP = 96, 48
#: Words that are no n-gram by themselves: a statement that has only these in common with a template says nothing.
STOP = (
    "the", "of", "and", "to", "in", "a", "is", "or", "any", "this", "for", "by", "be", "are", "may", "with", "on", "as", "an", "not", "no", "at", "all", "you", "v",
    "it", "its", "can", "if", "that", "from", "have", "has", "had", "was", "were", "will", "shall", "must", "which", "who", "their", "they", "he", "she", "his", "her", "we", "our", "your",
    "so", "but", "do", "does", "other", "either", "more", "one", "use", "used", "these", "such", "into", "than", "when", "out", "up", "there", "been", "would", "could", "should", "des", "de", "la", "die", "der",
)


@dataclass
class Model:
    families: list[str]
    grams: list[str]
    weights: np.ndarray  # grams x families, of each family against unknown, over the temperature
    bias: np.ndarray


def _grams(line: str) -> set[str]:
    t = re.findall(TOKEN, line.lower())
    return {x for x in [*t, *(f"{a} {b}" for a, b in zip(t, t[1:], strict=False))] if any(w not in STOP for w in x.split())}


def train(docs: DataFrame, negatives: int = NEGATIVES, seed: int = 6) -> Model:
    """Model from TEMPLATES, DECOYS and at most `negatives` paragraphs: one by hash of the document of least hash in each cell."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    known = {g for ts in TEMPLATES.values() for t in ts for g in _grams(t)}
    h = F.xxhash64("doc_id")
    keyed = docs.filter("text IS NOT NULL").select(F.pmod(h, F.lit(negatives)).alias("c"), h.alias("h"), "text")
    least = keyed.groupBy("c").agg(F.min("h").alias("h"))
    parts = keyed.join(F.broadcast(least), ["c", "h"]).select("c", "h", F.split("text", _BLANK).alias("ps"))
    picked = parts.select("c", _tokens(F.get("ps", F.pmod(F.xxhash64("h"), F.size("ps")).cast("int"))).alias("t"))
    # of a paragraph only what the templates have too, and some words to put around them
    picked = picked.select("c", F.struct(F.array_sort(F.array_intersect(F.concat("t", _pairs("t")), F.array(*map(F.lit, sorted(known))))).alias("grams"), F.slice("t", 1, 60).alias("words")).alias("m"))
    corpus = [r["m"] for r in picked.groupBy("c").agg(F.min("m").alias("m")).orderBy("c").collect()]
    filler = [w for m in corpus for w in m["words"]][:5000] or ["x"]
    rows, y, held = [], [], []
    for k, f in enumerate(families):
        for t in TEMPLATES[f]:
            ws = t.split()
            for i in range(12):
                drop = rng.random(len(ws)) < (0, 0.1, 0.2)[i % 3]
                around = [str(w) for w in rng.choice(filler, 2 * (i % 4))]
                half = len(around) // 2
                rows.append(_grams(" ".join([*around[:half], *(w for w, d in zip(ws, drop, strict=True) if not d), *around[half:]])))
                y.append(k)
                held.append(i % 4 == 3)
    for i, g in enumerate([*map(_grams, DECOYS * 4), *(g for g in (set(m["grams"]) for m in corpus) if not _looks_licensed(g))]):
        rows.append(g)
        y.append(len(families))
        held.append(i % 4 == 3)
    grams = sorted(known)
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)))
    for i, r in enumerate(rows):
        x[i, [at[g] for g in r if g in at]] = 1
    y, held = np.array(y), np.array(held)
    n = len(families) + 1
    # every class counts alike
    c = 1 / np.bincount(y, minlength=n)[y]
    fit = ~held
    w, b = np.zeros((len(grams), n)), np.zeros(n)
    onehot = np.eye(n)[y]
    xf, of, cf = x[fit], onehot[fit], c[fit][:, None] / c[fit].sum()
    rate, l1 = 2.0, 2e-4
    for _ in range(400):
        p = _softmax(xf @ w + b)
        g = (p - of) * cf
        w -= rate * (xf.T @ g)
        b -= rate * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    z = x[held] @ w + b
    nll = lambda t: -(c[held] * np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[held]], 1e-12))).sum()
    temperature = min(np.geomspace(0.1, 10, 60), key=nll)
    d, e = (w[:, :-1] - w[:, -1:]) / temperature, (b[:-1] - b[-1]) / temperature
    used = np.abs(d).max(1) > 1e-9
    # without any n-gram a paragraph must be unknown
    return Model(families, [g for g, u in zip(grams, used, strict=True) if u], d[used], np.minimum(e, -0.5))


def _looks_licensed(g: set[str]) -> bool:
    return any(len(g & _grams(t)) >= 0.5 * len(_grams(t)) for ts in TEMPLATES.values() for t in ts)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"), F.lit(1))


def _pairs(t: str) -> Column:
    return F.zip_with(F.col(t), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


#: Between paragraphs: lines without a letter or digit; and the same with the number of each line before it.
_BLANK = r"(?:^|\n)[^\p{L}\p{N}\n]*(?=\n|\z)"
_NUMBERED_BLANK = r"(?:^|\n)\d+\x00[^\p{L}\p{N}\n]*(?=\n|\z)"


def scan(docs: DataFrame, m: Model, least: float = LEAST) -> DataFrame:
    """Rows (doc_id, paragraph, predicted, score, confirmed, family): the lines (1-based) predicted as other than unknown, and
    the wrapped paragraphs that say more than their lines, at their first line with a word that speaks for a family; family is
    the prediction if a template confirms it, else unknown."""
    speaks = [g for g, w in zip(m.grams, m.weights, strict=True) if w.max() > 0]
    words = sorted({max((w for w in g.split() if w not in STOP), key=len) for g in speaks})
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    # by first letter, so that most places of a text are passed after one look
    gate = r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in sorted(by.items())) + r")(?![a-z0-9])" if words else r"$^"
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\0"), x)), "\n")
    # a number for each row, as rows may repeat
    numbered_rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text").filter(F.col("text").rlike(gate))
    paragraphs = numbered_rows.select("doc_id", "rid", F.posexplode(F.split(numbered, _NUMBERED_BLANK)).alias("block", "p")).filter(F.col("p").rlike(gate))
    number = lambda x, after="": F.regexp_extract(x, r"(?dm)^(\d+)\x00" + after, 1).cast("int")
    own = lambda x: F.regexp_replace(x, r"(?dm)^\d+\x00", "")
    line = lambda x: F.struct(F.lit(-1).alias("stretch"), number(x).alias("paragraph"), _tokens(own(x)).alias("t"))
    wraps = F.col("p").rlike(r"[^\n]\n[^\n]")
    both = paragraphs.select(
        "doc_id", "rid", "block", F.transform(F.filter(F.split("p", "\n"), lambda x: x.rlike(gate)), line).alias("lines"),
        F.when(wraps, number(F.col("p"), r"[^\n]*?" + gate)).alias("at"), F.when(wraps, _tokens(own(F.col("p")))).alias("all"),
    )
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("all") - STRETCH) / STEP), F.lit(0)).cast("int"))
    stretches = F.transform(starts, lambda k: F.struct(k.alias("stretch"), F.col("at").alias("paragraph"), F.slice("all", k * STEP + 1, F.lit(STRETCH)).alias("t")))
    none = F.array().cast("array<struct<stretch:int,paragraph:int,t:array<string>>>")
    lines = both.select("doc_id", "rid", "block", F.inline(F.concat("lines", F.when(F.col("all").isNotNull(), stretches).otherwise(none))))
    # how much of the best template of each family the paragraph has
    shares = F.array(*(F.array_max(F.array(*(F.size(F.array_intersect(F.array(*map(F.lit, ws)), F.col("t"))) / len(ws) for ws in ({*re.findall(TOKEN, t.lower())} for t in TEMPLATES[f])))) for f in m.families))
    grams = F.explode(F.array_distinct(F.concat("t", _pairs("t"))))
    table = docs.sparkSession.createDataFrame([(g, [float(x) for x in w]) for g, w in zip(m.grams, m.weights, strict=True)], "gram string, w array<double>")
    keyed = lines.select("doc_id", "rid", "block", "paragraph", "stretch", shares.alias("shares"), grams.alias("gram")).join(F.broadcast(table), "gram")  # a row for each n-gram of the templates
    sums = keyed.groupBy("doc_id", "rid", "block", "paragraph", "stretch").agg(F.first("shares").alias("shares"), *(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(m.families))))
    z = [F.col(f"z{i}") + float(b) for i, b in enumerate(m.bias)]
    total = sum((F.exp(F.least(x, F.lit(50.0))) for x in z), F.lit(1.0))
    best = F.array_max(F.array(*(F.struct(x.alias("z"), F.lit(-i).alias("i")) for i, x in enumerate(z))))
    got = sums.select("doc_id", "rid", "block", "paragraph", "stretch", "shares", best.alias("best"), total.alias("total")).withColumn("k", -F.col("best.i"))
    score = F.exp(F.least(F.col("best.z"), F.lit(50.0))) / F.col("total")
    got = got.select(
        "doc_id", "rid", "block", F.col("paragraph").cast("long").alias("paragraph"), "stretch", F.element_at(F.array(*map(F.lit, m.families)), F.col("k") + 1).alias("predicted"),
        score.alias("score"), (F.element_at("shares", F.col("k") + 1) >= CONFIRM).alias("confirmed"),
    ).filter(F.col("score") >= least)
    # a stretch counts once a family, where no line of its paragraph says so; lines that it confirms are part of it
    of = Window.partitionBy("doc_id", "rid", "block", "predicted")
    line = F.col("stretch") < 0
    sure = lambda x: F.coalesce(F.max(F.when(x, F.col("confirmed"))).over(of), F.lit(False))
    got = got.withColumns({"by_line": sure(line), "by_stretch": sure(~line), "any_line": F.max(line).over(of), "r": F.row_number().over(of.orderBy(line, F.desc("confirmed"), F.desc("score"), "stretch"))})
    whole = ~line & (F.col("r") == 1) & F.when(F.col("confirmed"), ~F.col("by_line")).otherwise(~F.col("any_line"))
    got = got.filter(whole | line & (F.col("confirmed") | F.col("by_line") | ~F.col("by_stretch")))
    return got.select("doc_id", "paragraph", "predicted", "score", "confirmed", F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN).alias("family"))
