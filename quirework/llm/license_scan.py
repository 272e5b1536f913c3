"""Licence scan by a trained paragraph classifier (operator 9, DataFrame functions only).

The model is multinomial logistic regression over word 1- to 3-grams, trained on the driver
from short licence notices, sentences that name other licences or none, and a bounded sample
of the corpus' own paragraphs (``sample_rows``, a parameter; the sample only adds examples of
class unknown). L1 shrinkage leaves a few hundred n-grams. Class unknown is calibrated by
cross-validation: every notice and every sentence is scored by a model that hasn't seen it;
the margin is the least that nearly all held-out sentences of class unknown stay under, and
a temperature, fitted to the same held-out scores, turns scores into probabilities.

A paragraph is a line, or a run of short lines (at most 100 characters, as notices are
wrapped) without a blank line between them; of a run, the lines are judged one by one and
together, and the run as a whole counts where its lines don't already say the same. On the
main path every paragraph of every document
is looked at: one without any word that speaks for a family has no way to leave class
unknown, and one regular expression finds those. The others are scored by a sum over the
model's n-grams, all inside one expression - no Python, no shuffle, no join. A prediction is
confirmed when the paragraph holds most of the bigrams of one of the family's templates.

Behaviour on odd input: null or empty texts have no paragraph and no finding; texts of any
length are scanned whole; repeated rows are scanned each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Notices as their licences publish them or as projects commonly word them.
NOTICES = {
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2 or any later version.",
        "Released under the terms of the GNU GPL v3.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GNU General Public License version 2.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the terms of the Apache License 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License. See LICENSE for details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the 3-clause BSD License.",
        "Released under the BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License v2.1 or later.",
        "Released under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Distributed under the GNU LGPL.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the MPL version 1.1.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License v1.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "Released under the EPL.",
        "Eclipse Public License - v 2.0 is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC license.",
        "Distributed under the ISC License.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Released under the Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "This article is available under CC BY 4.0.",
        "Licensed under CC BY-ND 3.0.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "Lizenziert unter CC BY-SA 4.0.",
        "Sous licence Creative Commons Attribution 4.0 International.",
        "Publicado bajo la licencia Creative Commons Atribuci\u00f3n 4.0.",
    ],
    "proprietary": [
        "Copyright 2020 Example Corporation. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying is prohibited.",
        "Copyright by the authors. All rights reserved.",
    ],
}
PLAIN = [
    "He lost his driving license on the way to the station.",
    "The license plate of the car was covered with mud.",
    "She is a licensed therapist and works in the city.",
    "The committee granted permission to build a new school.",
    "The software was free of charge for students.",
    "The general public was invited to the opening.",
    "A copy of the letter was found in the archive.",
    "Apache helicopters flew over the valley in the morning.",
    "The students of the institute at MIT won the contest.",
    "The terms of the contract were changed by the council.",
    "The rights of the citizens are reserved to the state.",
    "A creative person needs common sense.",
    "The bank may not use this file without notice.",
    "Version 3 of the plan was released in May.",
    "The foundation gave free meals to the poor.",
    "The source of the river lies in the mountains.",
    "The author reserves a table at the restaurant.",
    "The gnu lives in the open plains.",
    "The public library opens at nine.",
    "Under the terms of the truce both sides withdrew.",
    "International attribution of the painting is open to doubt.",
    "Copyright law is taught at the university.",
    "The article is about the history of the town.",
    "The work is hard and the pay is low.",
    "He bought a license for the software from the company.",
    "The license fee is due in March.",
    "You need a license to sell food here.",
    "The software license expires next year.",
    "They licensed the song to a film studio.",
    "The city issues a fishing license for five dollars.",
    "Permission is required to enter the garden.",
    "The conditions of the sale are met.",
    "The public license office is closed on Monday.",
    "Distributed systems are hard to test.",
    "The eclipse was visible to the public.",
    "Redistribution of wealth was debated in parliament.",
    "The Mozilla browser was released again.",
    "The public domain of the king was large.",
]
#: Notices of licences outside the families: class unknown, though they speak of licences.
OTHER = [
    "Licensed under the Artistic License 2.0.",
    "SPDX-License-Identifier: Artistic-2.0",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: BSL-1.0",
    "Licensed under the European Union Public Licence 1.2.",
    "SPDX-License-Identifier: EUPL-1.2",
    "Licensed under the zlib License.",
    "SPDX-License-Identifier: Zlib",
    "Released under the Unlicense.",
    "SPDX-License-Identifier: Unlicense",
    "Licensed under the Common Development and Distribution License.",
    "SPDX-License-Identifier: CDDL-1.0",
    "Licensed under the Microsoft Public License.",
    "Released under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: OFL-1.1",
    "Licensed under the PostgreSQL License.",
    "Released under the Python Software Foundation License Version 2.",
    "Licensed under the Open Database License.",
    "This project is released under the WTFPL.",
    "Distributed under the Academic Free License version 3.0.",
]
#: Too common to speak for a licence by themselves.
COMMON = frozenset(
    "a all and any are as at be by for from in is it may must no not of on or shall that the this to under was with without you your see more details use used used work document copy copies "
    "person part file forms source above following provided version released distributed available article program project notice free terms published obtain code available 0 1 2 3 4 2020 http www org can thank later met except if la le les de del der die das und sous bajo unter made form appear appears subject fee library program accompanying materials purpose list binary one v".split()
)
WORD = r"[a-z0-9]+"
EPOCHS, RATE, L1 = 400, 0.5, 2e-3
SAMPLE_ROWS = 400
CONFIRM = 0.6
CALIBRATION_QUANTILE = 0.02
LEAST_MARGIN = 0.05
FOLDS = 5
#: Characters of a line that may be part of a wrapped notice.
WRAPPED = 100
JOINT = "\x1e"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _variants(notice: str) -> list[str]:
    """The notice, its halves, and it among other words."""
    w = notice.split()
    cut = [notice, f"notice {notice} thank you", f"{notice} {PLAIN[len(w) % len(PLAIN)]}", f"{PLAIN[(3 * len(w)) % len(PLAIN)]} {notice}"]
    return cut + ([" ".join(w[: 2 * len(w) // 3]), " ".join(w[len(w) // 3 :])] if len(w) > 12 else [])


class Model:
    """Weights of n-grams against class unknown, whose own score is zero."""

    def __init__(self, families: list[str], bias: np.ndarray, weights: dict[str, np.ndarray], margin: float, temperature: float = 1.0):
        self.families, self.bias, self.weights, self.margin, self.temperature = families, bias, weights, margin, temperature

    def scores(self, text: str) -> np.ndarray:
        total = self.bias.copy()
        for g in ngrams(words_of(text)):
            if g in self.weights:
                total += self.weights[g]
        return total

    def predict(self, text: str) -> str:
        s = self.scores(text)
        return self.families[int(s.argmax())] if s.max() > self.margin else UNKNOWN

    def probability(self, text: str) -> float:
        """Of the best family among all classes; class unknown scores the margin."""
        s = self.scores(text) / self.temperature
        return float(1 / (np.exp(s - s.max()).sum() + np.exp(self.margin / self.temperature - s.max())))

    def triggers(self) -> list[str]:
        """Words one of which is in every n-gram that speaks for a family."""
        out = set()
        for g in (g for g, w in self.weights.items() if (w > 0).any()):
            out.add(max((w for w in g.split()), key=lambda w: (w not in COMMON, len(w), w)))
        return sorted(out)


def train(negatives: list[str], epochs: int = EPOCHS) -> Model:
    """Proximal gradient descent on notices against sentences of other licences or none; deterministic."""
    families = sorted(NOTICES)
    rows = [(v, k, i) for k, f in enumerate(families) for i, notice in enumerate(NOTICES[f]) for v in _variants(notice)]
    rows += [(t, len(families), i) for i, t in enumerate([*PLAIN, *OTHER, *negatives])]
    grams = [ngrams(words_of(t)) for t, _, _ in rows]
    seen: dict[str, int] = {}
    for g, (_, k, i) in zip(grams, rows, strict=True):
        # other licences' words count too: their weights keep class unknown together
        if k < len(families) or i in range(len(PLAIN), len(PLAIN) + len(OTHER)):
            for x in g:
                seen[x] = seen.get(x, 0) + 1
    vocabulary = sorted(x for x in seen if any(w not in COMMON and len(w) > 1 for w in x.split()))
    at = {x: i for i, x in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, g in enumerate(grams):
        x[i, [at[y] for y in g if y in at]] = 1
    y = np.zeros((len(rows), len(families) + 1))
    y[np.arange(len(rows)), [k for _, k, _ in rows]] = 1
    balance = 1 / y.sum(axis=0)
    importance = (y * balance).sum(axis=1, keepdims=True)
    importance /= importance.mean()
    fold = np.array([i % FOLDS for _, _, i in rows])
    # sentences without any n-gram of the vocabulary are alike: one of a fold stands for all, with their weight
    blank = (x.sum(axis=1) == 0) & (y[:, -1] == 1)
    total = len(rows)
    for f in range(FOLDS):
        alike = np.flatnonzero(blank & (fold == f))
        importance[alike[:1]] = importance[alike].sum()
        blank[alike[:1]] = False
    x, y, importance, fold = x[~blank], y[~blank], importance[~blank], fold[~blank]

    def fit(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(vocabulary), len(families) + 1)), np.zeros(len(families) + 1)
        xs, ys, ks = x[use], y[use], importance[use]
        scale = importance.sum() / (ks.sum() * total)
        for _ in range(epochs):
            z = xs @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = ks * (p - ys) * scale
            w -= RATE * (xs.T @ d)
            b -= RATE * d.sum(axis=0)
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0)
        return w[:, :-1] - w[:, -1:], b[:-1] - b[-1:]

    # calibration: every row scored by a model that hasn't seen its notice
    scores = np.zeros((len(x), len(families)))
    for f in range(FOLDS):
        w, b = fit(fold != f)
        scores[fold == f] = x[fold == f] @ w + b
    # sentences without such an n-gram stay unknown anyhow: the margin is for those that share words with notices
    near = (y[:, -1] == 1) & (x.sum(axis=1) > 0)
    margin = max(LEAST_MARGIN, float(np.quantile(scores[near].max(axis=1), 1 - CALIBRATION_QUANTILE)))
    temperature = _temperature(np.column_stack([scores, np.full(len(x), margin)]), y.argmax(axis=1))
    w, b = fit(np.ones(len(x), dtype=bool))
    weights = {g: np.round(w[i], 6) for g, i in at.items() if np.abs(w[i]).max() > 1e-6}
    return Model(families, np.round(b, 6), weights, round(margin, 6), temperature)


def _temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of held-out scores that makes them most likely, of a fixed ladder."""
    best = (math.inf, 1.0)
    for t in [round(0.1 * 1.25**i, 6) for i in range(18)]:
        z = scores / t
        top = z.max(axis=1)
        loss = float(np.mean(np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(z)), classes]))
        best = min(best, (loss, t))
    return best[1]


def _bigrams_of(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _trigrams_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.zip_with(pairs, F.slice(words, F.lit(3), n), lambda a, b: F.concat_ws(" ", a, b))


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_paragraphs, findings) of every row.

    findings: array of (paragraph, family, probability, template_share, confirmed) of the
    paragraphs that are not unknown, in their order; paragraphs, blank ones too, count from 0.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    if model is None:
        model = trained(df.sparkSession, df.select(body.alias("text")), sample_rows)
    families = model.families
    # the model is one literal map, n-gram -> weights
    table = F.create_map(*(c for g, w in sorted(model.weights.items()) for c in (F.lit(g), F.array(*(F.lit(float(v)) for v in w)))))
    trigger = r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, model.triggers())) + r")(?![a-z0-9])"
    templates = F.array(
        *(F.struct(F.lit(f).alias("family"), F.array(*(F.lit(g) for g in sorted(_pairs(n)))).alias("pairs")) for f in families for n in NOTICES[f])
    )
    zero = F.array(*(F.lit(float(b)) for b in model.bias))

    names, keys = F.array(*map(F.lit, families)), F.array(*map(F.lit, sorted(model.weights)))

    # each step binds its result to the next one's argument, so that nothing is computed twice
    def words(p: Column) -> Column:
        return F.struct(p["at"].alias("at"), p["part"].alias("part"), F.regexp_extract_all(F.lower(p["line"]), F.lit(f"({WORD})"), 1).alias("words"))

    def grams(p: Column) -> Column:
        pairs = F.array_distinct(_bigrams_of(p["words"]))
        known = F.array_intersect(F.concat(p["words"], _bigrams_of(p["words"]), _trigrams_of(p["words"])), keys)
        return F.struct(p["at"].alias("at"), p["part"].alias("part"), pairs.alias("pairs"), known.alias("known"))

    def scored(p: Column) -> Column:
        total = F.aggregate(p["known"], zero, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
        return F.struct(p["at"].alias("at"), p["part"].alias("part"), p["pairs"].alias("pairs"), total.alias("scores"))

    def best(p: Column) -> Column:
        return F.struct(*(p[c].alias(c) for c in ("at", "part", "pairs", "scores")), F.array_max(p["scores"]).alias("score"))

    def named(p: Column) -> Column:
        # probability among all classes; class unknown scores the calibrated margin
        warm = F.lit(model.temperature)
        odds = F.aggregate(p["scores"], F.exp((F.lit(model.margin) - p["score"]) / warm), lambda acc, x: acc + F.exp((x - p["score"]) / warm))
        family = F.element_at(names, F.array_position(p["scores"], p["score"]).cast("int"))
        return F.struct(p["at"].alias("paragraph"), p["part"].alias("part"), family.alias("family"), F.round(1 / odds, 6).alias("probability"), p["pairs"].alias("pairs"), p["score"].alias("score"))

    def compared(p: Column) -> Column:
        own = F.filter(templates, lambda t: t["family"] == p["family"])
        share = F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(t["pairs"], p["pairs"])) / F.size(t["pairs"])))
        return F.struct(*(p[c].alias(c) for c in ("paragraph", "part", "family", "probability")), F.round(share, 6).alias("template_share"))

    def confirmed(p: Column) -> Column:
        return F.struct(*(p[c].alias(c) for c in ("paragraph", "part", "family", "probability", "template_share")), (p["template_share"] >= CONFIRM).alias("confirmed"))

    def settled(all_: Column) -> Column:
        """Without runs that say what one of their lines says, or say it less surely than a line."""

        def stays(f: Column) -> Column:
            line = lambda g: (g["paragraph"] == f["paragraph"]) & (g["part"] >= 0)
            said = F.exists(all_, lambda g: line(g) & g["confirmed"] & (g["family"] == f["family"]))
            return (f["part"] >= 0) | (~said & (f["confirmed"] | ~F.exists(all_, line)))

        kept = F.filter(all_, stays)
        return F.transform(kept, lambda f: F.struct(*(f[c].alias(c) for c in ("paragraph", "family", "probability", "template_share", "confirmed"))))

    def findings(hits: Column) -> Column:
        scores = hits
        for step in (words, grams, scored, best):
            scores = F.transform(scores, step)
        out = F.filter(scores, lambda p: p["score"] > model.margin)
        for step in (named, compared, confirmed):
            out = F.transform(out, step)
        return out

    def parts(u: Column, i: Column) -> Column:
        one = lambda x, j: F.struct(x.alias("line"), i.alias("at"), j.cast("int").alias("part"))
        held = F.split(u, JOINT)
        run = F.array(one(F.replace(u, F.lit(JOINT), F.lit(" ")), F.lit(-1)))
        return F.when(F.contains(u, F.lit(JOINT)), F.concat(F.transform(held, one), run)).otherwise(F.array(one(u, F.lit(0))))

    units = F.split(paragraphs(F.col("__body")), "\n")
    told = F.filter(F.transform(units, lambda u, i: F.when(u.rlike(trigger), parts(u, i))), lambda x: x.isNotNull())
    hits = F.when(F.col("__body").rlike(trigger), F.filter(F.flatten(told), lambda p: p["line"].rlike(trigger)))
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("__body"))
    count = F.size(F.filter(units, lambda x: F.trim(x) != "")).cast("long")
    found = source.select("doc_id", count.alias("n_paragraphs"), findings(hits).alias("found"))
    kind = "array<struct<paragraph:int,family:string,probability:double,template_share:double,confirmed:boolean>>"
    return found.select("doc_id", "n_paragraphs", F.coalesce(settled(F.col("found")), F.array().cast(kind)).alias("findings"))


def paragraphs(text: Column) -> Column:
    """The text with a paragraph a line: lines end without blanks, wrapped lines are joined by JOINT."""
    body = F.replace(text, F.lit(JOINT), F.lit(" "))
    loose = F.lit(False)
    for blank in " \t\r\f\x0b":
        loose = loose | F.contains(body, F.lit(blank + "\n"))
    ends = F.when(loose, F.regexp_replace(body, r"[ \t\r\f\x0B]+(?=\n)", "")).otherwise(body)
    # the newline comes first in the pattern: what stands before it is looked at there alone
    return F.regexp_replace(ends, rf"\n(?<=(?:^|\n)[^\n]{{1,{WRAPPED}}}\n)(?=[^\n]{{1,{WRAPPED}}}(?:\n|$))", JOINT)


def _pairs(notice: str) -> set[str]:
    w = words_of(notice)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def trained(spark: SparkSession, texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on notices and about sample_rows paragraphs of the corpus that name no licence word.

    A row gives its paragraphs to the sample if its keyed digest is under a threshold, which
    follows from the number of rows, so that about twice sample_rows rows are looked at, and a
    few thousand paragraphs sorted, whatever the size of the table. The sample doesn't depend
    on the table's layout.
    """
    share = min(1.0, 2 * sample_rows / max(texts.count(), 1))
    threshold = min(int(-(2**63) + share * 2**64), 2**63 - 1)
    some = texts.filter((F.col("text") != "") & (F.xxhash64(F.lit("licence-rows"), "text") <= threshold))
    lines = some.select(F.explode(F.split(F.replace(paragraphs(F.col("text")), F.lit(JOINT), F.lit(" ")), "\n")).alias("line"))
    plain = ~F.lower("line").rlike("licen[cs]|copyright|rights reserved|public domain|redistribut|spdx|permission|lizen")
    found = lines.filter(plain & (F.trim("line") != "")).select("line", F.xxhash64(F.lit("licence-sample"), "line").alias("digest"))
    few = found.distinct().orderBy("digest", "line").limit(sample_rows)
    return train(sorted(r["line"] for r in few.collect()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the licence families each document's paragraphs name."""
    from quirework.llm.common import documents

    found = scan_licenses(documents(spark, sf_dir))
    names = lambda wanted: F.array_join(F.array_sort(F.array_distinct(F.transform(wanted, lambda f: f["family"]))), ",")
    confirmed = F.filter("findings", lambda f: f["confirmed"])
    doubtful = F.filter("findings", lambda f: ~f["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_findings"), F.size(confirmed).cast("long").alias("n_confirmed"), names(confirmed).alias("families"), names(doubtful).alias("unconfirmed")
    )
