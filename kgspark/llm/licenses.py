"""Operator 5 [native]: licence notices by a trained paragraph classifier, confirmed against templates.

A paragraph is a run of lines without a blank one; a notice may be wrapped over its lines, and a paragraph may hold
several.  Wherever a cue word of a template stands, the words around it are compared with that template; if enough of
its word pairs stand there, a sparse logistic regression over word n-grams tells the family of this stretch of words, or
that it is none.  Every family that is confirmed and told is reported, by the line it starts in.

Its features are the n-grams of the training notices that hold a cue (a word such as ``licensed``, ``gnu`` or ``cc by``);
their values are 1 over the root of how many a paragraph has.  The unknown class is trained on sentences that use the
same words otherwise, and calibrated: a family counts if its probability reaches a threshold above what held-out
sentences of that kind get.  Templates hold no holder and no year.

The model is trained on the notices below, which are constants: a few hundred lines on the driver.  Documents are only
touched by DataFrame functions: substring tests choose documents, then paragraphs, and words without a cue have no
feature, so that those tests decide nothing that the model would decide otherwise.  No shuffle, no join.

Null or empty text: no paragraph.  Repeated rows and repeated lines: each is reported.  Very long lines: whole.
Of overlapping notices of one family the first is reported.  Null ids stay null.  Columns besides doc_id and text are not
read, so their names do not matter.  No documents: no rows.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.shared import table

NGRAM, CONFIRMED = 4, 0.6
#: Beginnings of words, and words, without which a paragraph has no feature.
CUES = ("licen", "copyright", "permission", "warrant", "redistribut", "apache", "mozilla", "gnu", "gpl", "lgpl", "agpl", "spdx", "cc0", "unlicense")
PHRASES = ("cc by", "creative commons", "public domain", "all rights reserved")

NAMES = {
    "MIT": ["MIT License", "MIT license", "the MIT License (MIT)", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0 license", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0 license", "GPLv3"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3.0", "LGPL-2.1 license", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0 license", "AGPLv3"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause license", "BSD license"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0 license"],
    "ISC": ["ISC License", "ISC license"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 3.0", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons Zero license", "CC0 public domain dedication"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Proprietary": [],
}
FRAMES = ["{}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This program is free software under the {}.", "SPDX-License-Identifier: {}", "The code is available under the {} and the documentation too.", "See the {} for details."]
#: Longer notices, and the other sentences of a family.
NOTICES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "ISC": ["Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "Copyright (c) 2019 Example Inc. All rights reserved. Redistribution is prohibited.", "All rights reserved. No part may be reproduced without written permission.", "Confidential and proprietary. Copyright Example. All rights reserved."],
}
#: What a notice is confirmed by where the training notices name a holder and a year: the words that do not vary.
INVARIANT = {"Proprietary": ["all rights reserved", "redistribution is prohibited", "no part may be reproduced without written permission"]}
OTHER = [
    "She lost her driving licence and had to ask for a new one.", "He has a license to practise medicine in two states.", "They applied for a fishing license last summer.", "The pub lost its liquor license.",
    "Permission to land was refused.", "He left without permission.", "You need the permission of your parents.", "The police had a warrant for his arrest.", "The machine comes with a two year warranty.", "The evidence does not warrant such a claim.",
    "Apache helicopters flew over the valley.", "The Apache people live in the south west.", "A gnu is a large antelope.", "The gnu grazed near the river.", "Taxes redistribute income.", "The redistribution of wealth was debated.",
    "Copyright law protects authors.", "The court heard a copyright case.", "Poetic license allows for that.", "A license plate was found on the road.", "The public domain debate went on.", "The commons voted on creative industries.",
    "The licensing board met on Monday.", "Licensed doctors may join.", "An unlicensed driver was stopped.", "Mozilla was founded long ago.", "The company licensed its brand to a toy maker.", "A licensee pays a fee.", "License fees rose in May.", "Any license needs a version of the form.",
    "We reserve all rights in the matter to the court.", "The warranty covers parts.", "With his permission they went home.", "The television licence is due.",
]


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def has_cue(gram: str) -> bool:
    return any(w.startswith(c) for w in gram.split() for c in CUES) or any(f" {p} " in f" {gram} " for p in PHRASES)


def features_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({g for n in range(1, NGRAM + 1) for i in range(len(w) - n + 1) if has_cue(g := " ".join(w[i : i + n]))})


def examples() -> list[tuple[str, str]]:
    found = [(f.format(name), family) for family, names in NAMES.items() for name in names for f in FRAMES] + [(t, family) for family, texts in NOTICES.items() for t in texts for _ in range(4)]
    return found + [(t, "") for t in OTHER]


@lru_cache(maxsize=1)
def trained() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """(classes with unknown first, weights by n-gram, biases, threshold): multinomial logistic loss, shrunk to sparsity.

    A third of the sentences of the unknown class is held out; the threshold lies above the most that a held-out sentence of the
    unknown class gets for a family, and at a half at least.
    """
    rows = examples()
    kinds = ["", *NAMES]
    held = [k for k in range(len(rows)) if (len(rows) - k) % 3 == 1 and not rows[k][1]]  # counted from the end: the same sentences whatever notices are added
    train = [k for k in range(len(rows)) if k not in set(held)]
    grams = sorted({g for k in train for g in features_of(rows[k][0])})
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)))
    for k, (text, _) in enumerate(rows):
        hit = [place[g] for g in features_of(text) if g in place]
        x[k, hit] = 1 / np.sqrt(len(hit)) if hit else 0
    y = np.eye(len(kinds))[[kinds.index(f) for _, f in rows]]
    w, b, rate, shrink = np.zeros((len(grams), len(kinds))), np.zeros(len(kinds)), 8.0, 2e-6
    share = np.where(y[train][:, :1] > 0, len(train) / 4 / max(1, y[train][:, 0].sum()), 1.0)  # the unknown class weighs a quarter of all
    for _ in range(2000):
        z = x[train] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - y[train]) * share / share.sum()
        w -= rate * (x[train].T @ p)
        b -= rate * p.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0)
    z = x[held] @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    threshold = min(0.9, max(0.5, float(p[:, 1:].max()) + 0.02))
    used = np.flatnonzero(np.abs(w).max(1) > 0)
    return kinds, {grams[i]: [round(float(v), 6) for v in w[i]] for i in used}, [float(v) for v in b], threshold


def templates() -> list[tuple[str, list[str]]]:
    """(family, words) of its names and notices (a name of one word: with the word before it)."""
    found: list[tuple[str, list[str]]] = []
    for family in NAMES:
        texts = [words_of(t) for t in INVARIANT.get(family) or [*NAMES[family], *NOTICES.get(family, [])]]
        single = sorted({w[0] for w in map(words_of, [*NAMES[family], family]) if len(w) == 1})
        texts = [w for w in texts if len(w) > 1] + [[before, w] for w in single for before in ("under", "the", "identifier", "or", "and")]
        found += [(family, w) for k, w in enumerate(texts) if w not in texts[:k]]
    return found


def slack(n: int) -> int:
    """Words that a notice may have besides those of a template of n words, on either side of where it is expected."""
    return n if n >= 8 else n // 4


def anchors() -> dict[str, list[dict[str, int]]]:
    """By word: the templates that are looked for where it stands, and its place in them (cue words; without one, the last word)."""
    found: dict[str, list[dict[str, int]]] = {}
    for t, (_, words) in enumerate(templates()):
        cued = [k for k, w in enumerate(words) if any(w.startswith(c) for c in CUES)] or [len(words) - 1]
        for k in cued:
            found.setdefault(words[k], []).append({"t": t, "k": k})
    return found


def _mentions(text: Column) -> Column:
    """Whether a lower-case text holds a cue; what stands between the words of a phrase does not matter."""
    found = F.lit(False)
    for cue in CUES:
        found |= F.contains(text, F.lit(cue))
    for phrase in PHRASES:
        parts = phrase.split()
        held = F.contains(text, F.lit(parts[0]))
        for part in parts[1:]:
            held &= F.contains(text, F.lit(part))
        found |= held & text.rlike("[^a-z0-9]+".join(parts))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, n_features): every confirmed licence notice, by the line it starts in."""
    kinds, weights, bias, threshold = trained()
    texts = templates()
    lower = docs.select("doc_id", F.lower("text").alias("text")).filter(_mentions(F.col("text")))
    lines = _once(lower, "lines", F.split("text", "\n")).drop("text")
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(F.regexp_replace(x, "\\s+", " ")) == "", i)), lambda i: i.isNotNull())
    blanks = _once(lines, "blanks", blank)
    blocks = F.transform(F.concat(F.array(F.lit(-1)), "blanks"), lambda s, j: F.struct((s + 1).alias("first"), F.slice("lines", s + 2, F.coalesce(F.get("blanks", j), F.size("lines")) - s - 1).alias("lines")))
    block = blanks.select("doc_id", F.explode(blocks).alias("b")).select("doc_id", "b.first", "b.lines").filter(_mentions(F.array_join("lines", " ")))
    cut = _once(block, "cut", F.transform("lines", lambda x: F.filter(F.split(F.regexp_replace(x, "[^a-z0-9]+", " "), " "), lambda w: w != ""))).drop("lines")
    words = _once(_once(cut, "words", F.flatten("cut")), "at", F.flatten(F.transform("cut", lambda ws, i: F.array_repeat(i + F.col("first"), F.size(ws))))).drop("cut").filter(F.size("words") > 0)
    known_anchors = F.from_json(F.lit(json.dumps(anchors())), "map<string,array<struct<t:int,k:int>>>")
    met = F.flatten(F.filter(F.transform("words", lambda w, i: F.transform(F.element_at(known_anchors, w), lambda a: F.struct(a.t.alias("t"), F.greatest(i - a.k, F.lit(0)).alias("start")))), lambda x: x.isNotNull()))
    starts = _once(words, "found", F.array_distinct(met)).filter(F.size("found") > 0)
    pairs_of = F.array(*[F.array(*[F.lit(x) for x in sorted({" ".join(w[i : i + 2]) for i in range(len(w) - 1)})]) for _, w in texts])
    length_of, slack_of, family_of = (F.array(*[F.lit(v) for v in vs]) for vs in ([len(w) for _, w in texts], [slack(len(w)) for _, w in texts], [f for f, _ in texts]))

    def of(constants: Column, c: Column) -> Column:
        return F.get(constants, c.t)

    def compared(c: Column) -> Column:
        begin = F.greatest(c.start - of(slack_of, c), F.lit(0))
        near = F.slice("words", begin + 1, c.start - begin + of(length_of, c) + of(slack_of, c))
        share = F.size(F.array_intersect(_runs(near, 2), of(pairs_of, c))) / F.size(of(pairs_of, c)).cast("double")
        return F.struct(c.t.alias("t"), c.start.alias("start"), (c.start + of(length_of, c)).alias("stop"), share.alias("similarity"))

    confirmed = _once(starts, "sure", F.filter(F.transform("found", compared), lambda c: c.similarity >= CONFIRMED)).drop("found").filter(F.size("sure") > 0)
    # where the template's pairs stand first: a second copy right behind is not taken for the end of this one
    here = F.transform("sure", lambda c: F.struct(c.alias("c"), _runs(_part(c, F.lit(0), of(length_of, c) / 4), 2).alias("r")))
    confirmed = _once(confirmed, "here", here).drop("sure")
    spots = F.transform("here", lambda x: F.struct(x.c.alias("c"), F.transform(F.array_intersect(x.r, of(pairs_of, x.c)), lambda g: (x.c.start + F.array_position(x.r, g) - 1).cast("int")).alias("p")))
    confirmed = _once(confirmed, "spots", spots).drop("here")
    spans = F.transform("spots", lambda x: F.struct(x.c.t.alias("t"), x.c.start.alias("start"), x.c.stop.alias("stop"), x.c.similarity.alias("similarity"), F.coalesce(F.array_min(x.p), x.c.start).alias("first"), F.coalesce(F.array_max(x.p) + 2, x.c.stop).alias("last")))
    confirmed = _once(confirmed, "sure", spans).drop("spots")
    # a notice is classified with the words before it, which may tell the family, and without them, which may name another one
    views = F.flatten(F.transform("sure", lambda c: F.transform(F.array(F.lit(0), F.lit(NGRAM - 1)), lambda before: F.struct(c.alias("c"), _part(c, before, of(length_of, c) / 4).alias("w")))))
    view = _once(confirmed, "view", views).drop("sure", "words")
    cued = F.transform("view", lambda v: F.struct(v.c.alias("c"), F.filter(F.array_distinct(F.flatten(F.array(*[_runs(v.w, n) for n in range(1, NGRAM + 1)]))), lambda g: g.rlike(_CUE_PATTERN)).alias("g")))
    view = _once(view, "cued", cued).drop("view")
    known = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")  # a constant of about a thousand entries
    hits = F.transform("cued", lambda v: F.struct(v.c.alias("c"), F.filter(F.transform(v.g, lambda g: F.element_at(known, g)), lambda x: x.isNotNull()).alias("h")))
    view = _once(view, "hits", F.filter(hits, lambda v: F.size(v.h) > 0)).drop("cued").filter(F.size("hits") > 0)
    zero, biases = F.array(*[F.lit(0.0) for _ in kinds]), F.array(*[F.lit(v) for v in bias])
    logits = F.transform("hits", lambda v: F.struct(v.c.alias("c"), F.size(v.h).alias("n"), F.zip_with(F.aggregate(v.h, zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)), biases, lambda a, b: a / F.sqrt(F.size(v.h).cast("double")) + b).alias("z")))
    view = _once(view, "logits", logits).drop("hits")
    tops = F.transform("logits", lambda v: F.struct(v.c.alias("c"), v.n.alias("n"), v.z.alias("z"), F.array_max(v.z).alias("top")))
    view = _once(view, "tops", tops).drop("logits")
    named = F.transform("tops", lambda v: F.struct(v.c.first.alias("start"), v.c.last.alias("stop"), F.get(F.array(*[F.lit(k) for k in kinds]), F.array_position(v.z, v.top).cast("int") - 1).alias("family"), of(family_of, v.c).alias("wanted"), (1.0 / F.aggregate(v.z, F.lit(0.0), lambda a, z: a + F.exp(z - v.top))).alias("probability"), v.c.similarity.alias("similarity"), v.n.alias("n_features")))
    view = _once(view, "named", F.array_sort(F.filter(named, lambda v: (v.family == v.wanted) & (v.probability >= threshold)))).drop("tops")
    # of notices of one family that overlap, the first; no more than ``reach`` can start in the longest notice before one
    reach = 2 * len(texts) * 2 * max(len(w) for _, w in texts)
    view = _once(view.filter(F.size("named") > 0), "firsts", F.filter("named", lambda v, i: ~F.exists(F.slice("named", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), lambda u: (u.family == v.family) & (u.stop > v.start))))
    one = view.select("doc_id", "at", F.explode("firsts").alias("v"))
    return one.select("doc_id", F.get("at", F.col("v.start")).alias("paragraph"), "v.family", "v.probability", "v.similarity", "v.n_features")


def _part(c: Column, before: Column, after: Column) -> Column:
    begin = F.greatest(c.start - before, F.lit(0))
    return F.slice("words", begin + 1, (c.stop - begin + after).cast("int"))


def _runs(words: Column, n: int) -> Column:
    """The runs of n words."""
    if n == 1:
        return words
    return F.filter(F.transform(words, lambda w, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, F.lit(n)), " "))), lambda g: g.isNotNull())


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once: generators are not folded into what refers to them, plain columns are."""
    return df.select("*", F.explode(F.array(value)).alias(name))


_CUE_PATTERN = "(^| )(" + "|".join(CUES) + ")|(^| )(" + "|".join(PHRASES) + ")( |$)"


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
