"""Licence scans: a trained paragraph classifier, in DataFrame functions alone.

Features are words and word pairs of a paragraph; a multinomial logistic regression with
an L1 penalty gives each licence family and `unknown` a probability. It is trained on the
driver from the names and texts of well-known licences, set in sentences of notices and
with words left out, against sentences that only sound like notices. Two numbers
calibrate it on other sentences, kept out of the training: a temperature and the bias of
`unknown`. A paragraph's family is confirmed if it holds enough of the word pairs of one
of the family's names or texts.

Listed are the paragraphs of a family, and those of none that hold a cue word. Texts and
paragraphs without any word of the gate are not scored: their features, all together,
cannot outweigh the lead of `unknown` (see Model.gate), so they are of no family.

A paragraph is a run of lines with letters or digits. It ends early where a line ends a
sentence and the next starts with a capital, and around a line that is a confirmed notice
by itself; so a notice may be wrapped anywhere, behind marks of comments too, and one on a
line of its own stays apart.

Cases: null and empty texts have no paragraphs; a line or a paragraph may have any length;
equal probabilities go to the family first by name; repeated rows give repeated results;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of well-known licences by family, and sentences of their texts and notices.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3", "AGPL-3.0", "AGPL"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License"],
    "artistic-2.0": ["Artistic License 2.0", "Artistic-2.0", "Perl Artistic License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license", "New BSD License"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "BSL-1.0", "Boost License"],
    "busl-1.1": ["Business Source License 1.1", "BUSL-1.1"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc-by-nc-nd": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"],
    "cc-by-nc-sa": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0"],
    "cddl-1.0": ["Common Development and Distribution License", "CDDL-1.0", "CDDL"],
    "epl-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License v1.0", "EPL-2.0", "EPL 2.0"],
    "eupl-1.2": ["European Union Public Licence, version 1.2", "EUPL-1.2", "EUPL"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPLv2", "GPL-2.0", "GPL 2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPLv3", "GPL-3.0", "GPL 3"],
    "isc": ["ISC License", "ISC"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL-2.1", "LGPL 2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPLv3", "LGPL-3.0", "LGPL 3"],
    "mit": ["MIT License", "MIT license", "Expat License"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "ms-pl": ["Microsoft Public License", "MS-PL"],
    "ofl-1.1": ["SIL Open Font License, Version 1.1", "OFL-1.1", "Open Font License"],
    "openssl": ["OpenSSL License", "SSLeay License"],
    "postgresql": ["PostgreSQL License"],
    "psf-2.0": ["Python Software Foundation License", "PSF License Agreement", "PSF-2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "wtfpl": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "zlib": ["zlib License", "zlib/libpng License"],
}
TEXTS = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsl-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software."],
    "busl-1.1": ["The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "cddl-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License)."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at the Eclipse Foundation."],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The software is provided as is.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "openssl": ["This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit."],
    "postgresql": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
}
# Sentences that name a licence, to train on and, others, to calibrate with.
FRAMES = ["Licensed under the {}.", "Released under the {}", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "Use of this source code is governed by the {}.", "{}"]
KEPT_FRAMES = ["This file may be used under the terms of the {}, see the file next to it.", "All code in this folder is covered by the {}.", "License: {}"]
# Sentences with the words of notices that grant no licence of a family, to train on and to calibrate with.
UNKNOWN = [
    "You need a license to drive a car in this country.", "The committee granted a license to the new station.", "All rights reserved.", "Licensed under terms to be agreed with the author.",
    "He was a student at MIT before the war.", "The apache helicopter landed near the village.", "This work was released to the public in version 3.", "A license fee applies to commercial use.",
    "Please read the license before you use the software.", "The general public was not admitted.", "Copyright by the publisher, no part may be copied.", "They released the song under a new name.",
    "The software is provided to licensed users only.", "The GNU is an antelope of the plains.", "Mozilla announced a new version of the browser.", "The creative commons of the village was open to all.",
    "Licensed premises close at ten.", "This file is licensed.", "Released under license.", "Permission to enter was granted by the guard.", "mit der Zeit und mit ihm", "The work of the group is distributed under the table.",
    "Permission is hereby granted to the members of the club to use the hall.", "The king hereby granted the town the right to hold a market.", "Entry is free of charge for any person with a ticket.", "The eclipse was visible to the public in all of Europe.",
    "An artistic license was taken with the facts.", "The python is a snake that people keep.", "The union published the terms of the agreement.", "The foundation published a version of the report.", "A copy of the notice was sent to the members.",
    "The business has a new source of income.", "She bought a font at the market.", "The common development of the region.", "The boost in sales came in May.", "Two versions of the text were distributed with the paper.",
    "The program is provided by the university.", "You may not use this door except in an emergency.", "The contents of this box are subject to change.", "This product includes nuts.", "Use of the pool is governed by the rules of the house.",
    "Anyone is free to go.", "The warranty covers all parts.", "No warranty of any kind is given with the ticket.", "The license of the driver was taken by the police.", "The public license office is open on Monday.",
    "Identifier: 3", "Version 2.0", "Version 3 of the plan", "4.0", "International license for pilots", "The code is licensed to the customer under the contract.", "Use is subject to the license terms of the vendor.",
]
KEPT_UNKNOWN = [
    "The author holds a licence as a pilot.", "Copyright 2020 the publisher. All rights reserved.", "This software is licensed to you by the vendor under the agreement.",
    "The library is free to use for members.", "In version 3 the public was asked again.", "Her work is distributed in many countries.", "The terms of the licence were published.", "No license is needed to fish here.",
    "The general met the public at the foundation.", "Software with a warranty costs more.", "The commons was mown in spring.",
]

#: Words with one of which a paragraph of no family is listed as unknown.
CUES = ["licence", "license", "licensed", "permission", "redistribution", "redistributions", "spdx-license-identifier"]
#: Words that are no feature by themselves or among themselves; those with a sign of a licence are.
COMMON = frozenset("a all an and any are as at be by can do file files for from has have in is it its may must no not of on one or other s shall should such that the this to use was were what which with without work you your used code source copy free mit under into being works list law want display including included nor anyone open related".split()) | frozenset("1 1.0 1.1 1.2 2 2.0 2.1 3 3.0 4.0".split())
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
CONFIRM = 0.6
PENALTY, STEPS = 4e-4, 300


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def grams(words: list[str]) -> set[str]:
    """Words and pairs of words."""
    return {*words, *pairs(words)}


def features_of(text: str) -> set[str]:
    return {g for g in grams(tokens(text)) if not COMMON.issuperset(g.split())}


def named(family: str) -> list[str]:
    """A family's names, and its identifier as files state it."""
    return [*NAMES[family], f"SPDX-License-Identifier: {family}", *(f"SPDX-License-Identifier: {n}" for n in NAMES[family] if len(tokens(n)) == 1)]


def templates() -> dict[str, list[list[str]]]:
    """By family, the word pairs of each name and text; the word itself where there is but one."""
    return {family: [pairs(w) or w for t in (*named(family), *TEXTS.get(family, [])) if (w := tokens(t))] for family in sorted(NAMES)}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    features: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def gate(self) -> list[str]:
        """Words without any of which no paragraph is of a family.

        Features are set aside, the weakest first, while all of them together, in one
        paragraph, would leave every family at or below `unknown`. Of each feature that is
        left one word goes into the gate, so a paragraph that has the feature passes.
        """
        lead = self.bias[-1] - self.bias[:-1]
        gain = np.maximum(self.weights[:, :-1] - self.weights[:, -1:], 0)
        spent, left = np.zeros(len(lead)), []
        for i in sorted(range(len(gain)), key=lambda i: (gain[i].max(), self.features[i])):
            if (spent + gain[i] <= lead - 1e-6).all():
                spent = spent + gain[i]
            else:
                left.append(self.features[i].split())
        words = {w[0] for w in left if len(w) == 1}
        often = Counter(w for pair in left if not words.intersection(pair) for w in pair if w not in COMMON)
        for pair in left:
            if not words.intersection(pair):
                words.add(max((w for w in pair if w not in COMMON), key=lambda w: (often[w], w)))
        return sorted(words)

    def probabilities(self, text: str) -> np.ndarray:
        g = features_of(text)
        z = (self.bias + sum((self.weights[i] for i, f in enumerate(self.features) if f in g), np.zeros(len(self.families)))) / self.temperature
        return softmax(z[None])[0]


def thinned(text: str, seed: int, times: int) -> list[str]:
    """A text, and versions of it with words left out."""
    rng = np.random.default_rng(seed)
    words = text.split()
    return [text, *(" ".join(w for w in words if rng.random() > 0.15) or text for _ in range(times))]


# What stands around words of notices that name no licence, to calibrate with.
KEPT_CONTEXTS = ["The {} helicopter landed near the village.", "They talked about {} all day.", "Our {} was developed at the institute.", "She wrote that {} compresses the data."]


def words_apart(own: list[str] | None = None) -> list[str]:
    """Words and short runs of words of names and notices, in contexts that no licence has: these are unknown.

    Without contexts of their own they stand between words that occur once, which are no
    features, so that only the words themselves are learned from.
    """
    alone = {w[0] for names in NAMES.values() for n in names if len(w := tokens(n)) == 1}
    notices = [tokens(t) for texts in TEXTS.values() for t in texts]
    names = [tokens(n) for family in NAMES for n in named(family)]
    words = sorted({w for t in (*notices, *names) for w in t} - COMMON - alone)
    runs = {" ".join(t[i : i + k]) for t in notices for k in (2, 3, 4) for i in range(len(t) - k + 1) if len(t) > 2 * k}
    runs |= {" ".join(t[i : i + 2]) for t in names if len(t) > 4 for i in range(len(t) - 1)}
    called = {" ".join(t) for t in names}
    found = [*words * 5, *sorted(r for r in runs - called if features_of(r))]
    if own:
        # Each word once, each context in turn; of runs every third.
        return [own[i % len(own)].format(x) for i, x in enumerate([*words, *found[5 * len(words) :: 3]])]
    return [f"a{i}q {x} b{i}q" for i, x in enumerate(found)]


def examples() -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(text, class) to train on, and to calibrate with; the last class is unknown."""
    train, kept = [], []
    families = sorted(NAMES)
    for k, family in enumerate(families):
        train += [(f"SPDX-License-Identifier: {family}", k)] * 5
        for name in NAMES[family]:
            train += [(f.format(name), k) for f in FRAMES]
            # As much of a name by itself as there is of a word that is none; a name of one word has nothing else to go by.
            train += [(f"c{len(train)}q {name} d{len(train)}q", k)] * (5 if len(tokens(name)) == 1 else 1)
            kept += [(f.format(name), k) for f in KEPT_FRAMES]
        for n, text in enumerate(TEXTS.get(family, [])):
            train += [(t, k) for t in thinned(text, 100 * k + n, 5)]
            words = text.split()
            train += [(" ".join(words[: len(words) // 2]), k), (" ".join(words[len(words) // 2 :]), k)]
            kept += [(" ".join(words[: 2 * len(words) // 3]), k)]
    for n, text in enumerate(UNKNOWN):
        train += [(t, len(families)) for t in thinned(text, n, 2)]
    strange, others = words_apart(), words_apart(own=KEPT_CONTEXTS)
    train += [(t, len(families)) for t in strange]
    kept += [(t, len(families)) for t in (*KEPT_UNKNOWN, *others)]
    return train, kept


@lru_cache(maxsize=1)
def train() -> Model:
    families = (*sorted(NAMES), "unknown")
    rows, kept = examples()
    sets = [features_of(t) for t, _ in rows]
    often = Counter(f for s in sets for f in s)
    features = tuple(sorted(f for f, n in often.items() if n > 1))
    number = {f: i for i, f in enumerate(features)}

    def matrix(found: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(found), len(features)), np.float32)
        for r, s in enumerate(found):
            x[r, [number[f] for f in s if f in number]] = 1
        return x

    a, t = matrix(sets), np.eye(len(families), dtype=np.float32)[[k for _, k in rows]]
    share = t.sum(0)
    weight = (1 / np.maximum(share, 1))[[k for _, k in rows]][:, None].astype(np.float32)
    weight[t[:, -1] > 0] *= 4
    weight /= weight.sum()
    # The step follows from the largest curvature, found by repeated products.
    scaled = a * np.sqrt(weight)
    top = np.ones(len(features), np.float32)
    for _ in range(30):
        top = scaled.T @ (scaled @ (top / np.linalg.norm(top)))
    step = np.float32(1.8 / (np.linalg.norm(top) + 1e-3))
    w, b = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32)
    v, c, m = w.copy(), b.copy(), 1.0
    for _ in range(STEPS):
        r = (softmax(a @ v + c) - t) * weight
        w2 = v - step * (a.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * PENALTY, 0)
        b2 = c - step * r.sum(0)
        m2 = (1 + math.sqrt(1 + 4 * m * m)) / 2
        v, c = w2 + (m - 1) / m2 * (w2 - w), b2 + (m - 1) / m2 * (b2 - b)
        w, b, m = w2, b2, m2
    w, b = w.astype(float), b.astype(float)
    held, truth = matrix([features_of(x) for x, _ in kept]) @ w + b, np.array([k for _, k in kept])

    def loss(temperature: float, shift: float) -> float:
        z = held.copy()
        z[:, -1] += shift
        return float(-np.log(softmax(z / temperature)[np.arange(len(truth)), truth] + 1e-12).mean())

    # The bias of unknown leads by a little at least, so a paragraph without any feature is unknown.
    least = max(0.0, float(b[:-1].max() - b[-1]) + 0.5)
    _, temperature, shift = min((loss(s, d), s, d) for s in np.geomspace(0.1, 3, 30) for d in least + np.linspace(0, 4, 41))
    b[-1] += shift
    used = np.abs(w).sum(1) > 0
    return Model(families, tuple(f for f, u in zip(features, used, strict=True) if u), w[used], b, float(temperature))


def one_of(words: list[str]) -> str:
    """A pattern of whole words, by their first letters, so most places are left after one step."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(re.escape(w[1:]).replace(r"\ ", "[^a-z0-9]+"))
    return rf"(?<![a-z0-9])(?:{'|'.join(f'{a}(?:{"|".join(rest)})' for a, rest in by.items())})(?![a-z0-9])"


def constant(value, ddl: str) -> Column:
    """A nested constant, read from its JSON once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, though functions over arrays use them for every element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (number of its first line from 0), family, probability, similarity and confirmed of each paragraph of a family or with a cue."""
    model = model or train()
    cue, some = one_of(CUES), one_of(sorted({*CUES, *model.gate()}))
    known = templates()
    # A line is a notice by itself if it holds CONFIRM of the pairs of a text, or all of a name.
    texts = [q for family in TEXTS.values() for t in family if (q := pairs(tokens(t)))]
    called = [q for family in NAMES for t in named(family) if (q := pairs(tokens(t)))]

    # Of those pairs one of any so many that the others are too few must stand there; those with fewest common words are asked for.
    rare = lambda q, share: sorted(q, key=lambda p: (len(COMMON.intersection(p.split())), -len(p)))[: len(q) - math.ceil(share * len(q)) + 1]
    sign = one_of(sorted({p for qs, share in ((texts, CONFIRM), (called, 1.0)) for q in qs for p in rare(q, share)}))

    def words_of(line: Column) -> Column:
        return F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"), 1)

    def pairs_of(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    def whole(line: Column) -> Column:
        """Whether the line is a confirmed notice by itself."""
        holds = lambda x, qs, share: F.exists(constant(qs, "array<array<string>>"), lambda q: F.size(F.array_intersect(q, x)) >= F.lit(share) * F.size(q))
        # A lambda's variable is worked out once, however often it is used; of the pairs only those of notices are looked at again.
        listed = constant(sorted({p for q in (*texts, *called) for p in q}), "array<string>")
        found = F.exists(F.array(words_of(line)), lambda w: F.exists(F.array(F.array_intersect(pairs_of(w), listed)), lambda x: holds(x, texts, CONFIRM) | holds(x, called, 1.0)))
        return F.when(F.rlike(F.lower(line), F.lit(sign)), found).otherwise(F.lit(False))

    def apart(a: Column, b: Column) -> Column:
        """Whether a paragraph ends between two lines."""
        blank = F.lit(r"^[^\p{L}\p{N}]*$")
        stop = F.rlike(a.line, F.lit(r"[.!?][\"')\]]*\s*$")) & F.rlike(b.line, F.lit(r"^[^\p{L}\p{N}]*\p{Lu}"))
        return F.rlike(a.line, blank) | F.rlike(b.line, blank) | stop | a.whole | b.whole

    hit = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.rlike(F.lower("text"), F.lit(some)))
    lines = held(hit.select("doc_id", "text"), lines=F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), whole(x).alias("whole")))).drop("text")
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | apart(F.get("lines", F.greatest(i - 1, F.lit(0))), F.get("lines", i)))
    runs = held(lines, starts=starts, texts=F.col("lines.line")).drop("lines")
    run = F.transform("starts", lambda b, j: F.struct(b.alias("paragraph"), F.array_join(F.slice("texts", b + 1, F.coalesce(F.get("starts", j + 1), F.size("texts")) - b), "\n").alias("line")))
    lines = runs.select("doc_id", F.inline(run)).where(F.rlike(F.lower("line"), F.lit(some)))
    words = held(lines, w=words_of(F.col("line")))
    words = held(words, g=F.concat("w", pairs_of(F.col("w")))).drop("w")
    table = constant({f: w.tolist() for f, w in zip(model.features, model.weights, strict=True)}, "map<string,array<double>>")
    start = constant(model.bias.tolist(), "array<double>")
    z = F.aggregate(F.array_intersect("g", F.map_keys(table)), start, lambda acc, x: F.zip_with(acc, F.element_at(table, x), lambda a, b: a + b))
    scored = held(words, z=F.transform(z, lambda v: v / F.lit(model.temperature)))
    scored = held(scored, top=F.array_max("z"))
    scored = held(scored, e=F.transform("z", lambda v: F.exp(v - F.col("top"))))
    scored = held(scored, most=F.array_max("e"))
    best = F.array_position("e", F.col("most")).cast("int")
    names = constant(list(model.families), "array<string>")
    scored = scored.select("doc_id", "paragraph", "line", "g", F.element_at(names, best).alias("family"), (F.col("most") / F.aggregate("e", F.lit(0.0), lambda a, v: a + v)).alias("probability"))
    scored = scored.where((F.col("family") != "unknown") | F.rlike(F.lower("line"), F.lit(cue)))
    own = F.element_at(constant(known, "map<string,array<array<string>>>"), F.col("family"))
    similarity = F.coalesce(F.array_max(F.transform("own", lambda q: F.size(F.array_intersect(q, F.col("g"))) / F.size(q))), F.lit(0.0))
    return held(scored, own=own).withColumn("similarity", similarity).select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"))
