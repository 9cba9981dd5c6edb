"""License scans: a paragraph classifier over sparse word n-grams, in DataFrame expressions.

A multinomial logistic regression over the presence of word 1- and 2-grams is trained on the driver from notice
templates (whole and with words left out) against a bounded sample of the corpus's own passages as the class `unknown`.
An n-gram that notices of several families share is no evidence for any of them and not in the model. Passages of the
sample that are notices themselves (a template covers them, or a first model finds a family) are left out of that class,
in training and in calibration. Half of what remains, with half of a list of confusable sentences and of notices of
families that are not known here, is held out: a family's threshold lies above every probability that the model gives it
there, and is 0.5 at least. With n held-out passages none of which passes, at most a share 1 - 0.05 ** (1 / n) of such
passages would pass, at a confidence of 95 % (LicenseModel.false_share).

A text's paragraphs are what stands between lines without a letter or digit. Judged are all lines, and of paragraphs of
several lines runs of 16 lines from every eighth one on, so that a notice that is wrapped (or set off by comment signs,
which are no words) is read as a whole. From the weights follow words of which any passage that reaches a threshold
holds at least one: without them all other n-grams together fall short. Only passages with such a word are scored in
full; the rest is `unknown` by that bound. A family is confirmed if the passage holds most n-grams of one of its
templates, and a document is named by the family with the most evidence over all its confirmed passages.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused
from .quality import let

UNKNOWN = "unknown"

#: Wording of public license notices, by family.
NOTICES: dict[str, list[str]] = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU Affero General Public License v3.0.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "AGPL-3.0-only",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "Artistic-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
        "The Artistic License 2.0. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "BSD-2-Clause",
        "BSD-3-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "Licensed under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-NC-SA": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-ND": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CDDL": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "EUPL": [
        'Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.',
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPLv3 license.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU General Public License v2.0 or later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License v3.0.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "OFL": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "PSF": [
        "Licensed to PSF under a Contributor Agreement.",
        "This module is licensed under the Python Software Foundation License Version 2.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
    "WTFPL": [
        "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2.",
        "Licensed under the WTFPL.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Released under the zlib license.",
    ],
}
TEMPLATES: list[tuple[str, str]] = [(family, text) for family, texts in NOTICES.items() for text in texts]

#: Sentences of notices of several families, which tell nothing about which.
SHARED = [
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "This program is free software: you can redistribute it and/or modify", "This program is free software; you can redistribute it and/or modify it under the terms of the license.",
    "Copyright (C) Free Software Foundation, Inc.", "You may not use this file except in compliance with the License.", "All rights reserved.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "Permission is hereby granted, free of charge, to any person", "Licensed under version 1.0 or version 2.0 of the license",
]

#: Notices of families that are not known here.
OTHERS = [
    "Academic Free License", "Licensed under the Academic Free License version 3.0.", "The software is licensed to you by the vendor under a commercial license agreement.", "Proprietary and confidential. Unauthorized copying of this file via any medium is strictly prohibited.",
    "Licensed under the Open Software License version 3.0.", "As long as you retain this notice you can do whatever you want with this stuff.", "Licensed under the Microsoft Public License (Ms-PL).", "Licensed under the Q Public License, Version 1.0.",
    "Business Source License 1.1", "Licensed under the Server Side Public License, version 1.", "Licensed under the Elastic License 2.0.", "This source code is governed by a license agreement between you and the company.",
    "Your use of this product is subject to the end user license agreement.", "Licensed under the Common Public License Version 1.0.",
]

#: Sentences with words of notices that are none.
CONFUSABLE = [
    "The license plate of the car was new.", "Permission to enter was denied.", "He asked for permission and a fishing licence.", "The redistribution of income is debated.",
    "Licensed taxis wait outside.", "An apache helicopter flew over.", "See the license terms of your vendor.", "The general public was not admitted.", "The park is open to the public free of charge.",
    "All rights reserved by the hotel.", "The software is provided by our partner in Boston.", "Creative people share a common interest.", "She won the attribution case in court.", "The mit of the boxer was torn.",
    "Copies of the letter were distributed to all members.", "The foundation published a version of the report.", "You may not use the lift without permission.", "A driving license is required to rent a car.",
    "The warranty covers any kind of damage to the engine.", "The artist retains the copyright of the painting.", "This file is large and it is subject to change.", "He works under a new contract with the public library.",
    "Er kam mit dem Zug nach Hause.", "Mit freundlichen Grüßen", "The apache tribe lived in the south.", "Ein Haus mit Garten und Blick auf den See.",
]

#: Words that are no n-grams of their own, and pairs of which are none.
COMMON = frozenset("a an and any are as at be but by can do for from has have if in is it its may no not of on or other so such that the their then there this to was we which with you your".split())

WORD = r"[a-z0-9]+"


def _grams(text: str) -> set[str]:
    words = re.findall(WORD, text.lower())
    pairs = zip(words, words[1:], strict=False)
    return {w for w in words if w not in COMMON} | {f"{a} {b}" for a, b in pairs if a not in COMMON or b not in COMMON}


_OWN = [(family, _grams(text)) for family, text in TEMPLATES]


def evidence() -> list[str]:
    """The n-grams that templates of one family alone hold, in order."""
    of: dict[str, set[str]] = {}
    for family, own in [*_OWN, *[(f"shared {k}", _grams(t)) for k, t in enumerate(SHARED)]]:
        for g in own:
            of.setdefault(g, set()).add(family)
    return sorted(g for g, families in of.items() if len(families) == 1 and not next(iter(families)).startswith("shared"))


def likeness(grams: set[str], family: str | None = None) -> float:
    """The largest share of n-grams in common with a template (of a family), of the smaller of both sets."""
    return max((len(grams & own) / max(1, min(len(own), len(grams))) for f, own in _OWN if family in (None, f)), default=0.0)


def coverage(grams: set[str], family: str) -> float:
    """The largest share of a template's n-grams (of the family's templates) that are among grams."""
    return max((len(grams & own) / max(1, len(own)) for f, own in _OWN if f == family), default=0.0)


#: A passage holds so large a part of a template.
CONFIRMED = 0.6
#: Lines of a run, and from one run's first line to the next one's.
RUN, STEP = 16, 8
_BLANK = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def passages(text: str) -> list[tuple[int, int, int, str]]:
    """(paragraph, first line in it, lines, words' text) of what is judged, as in scan()."""
    out = []
    for k, paragraph in enumerate(re.split(_BLANK, text)):
        lines = paragraph.split("\n")
        out += [(k, j, 1, line) for j, line in enumerate(lines)]
        if len(lines) > 1:
            out += [(k, j, min(RUN, len(lines) - j), " ".join(lines[j : j + RUN])) for j in range(0, len(lines), STEP) if j == 0 or j + STEP < len(lines)]
    return out


class LicenseModel:
    """weights: n-gram -> one weight for each family (unknown is the baseline with weight 0 and bias 0); thresholds:
    the probability each family must reach; false_share: see the module."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float], thresholds: list[float], false_share: float = 1.0) -> None:
        self.families, self.weights, self.bias, self.thresholds, self.false_share = families, weights, bias, thresholds, false_share

    def telling_words(self) -> list[str]:
        """Words of which any paragraph that reaches a threshold holds at least one: for each family, the positive
        weights of all n-grams without them add up to less than the threshold asks for."""
        limit = np.array([math.log(t / (1 - t)) for t in self.thresholds]) - np.array(self.bias) - 1e-6
        rest = {g: np.maximum(np.array(w), 0.0) for g, w in self.weights.items()}
        total, out = sum(rest.values(), np.zeros(len(self.families))), []
        while (total >= limit).any():
            short = np.maximum(total - limit, 0) > 0
            gain: dict[str, float] = {}
            for g, w in rest.items():
                for word in set(g.split()) - COMMON:
                    gain[word] = gain.get(word, 0.0) + float(w[short].sum())
            best = min(gain, key=lambda w: (-gain[w], w))
            out.append(best)
            for g in [g for g in rest if best in g.split()]:
                total = total - rest.pop(g)
        return out


def _fit(rows: list[tuple[set[str], int]], families: list[str], rounds: int, rate: float, sparse: float) -> LicenseModel:
    """Proximal gradient descent with momentum and an L1 penalty, over the n-grams of templates."""
    unknown = len(families)
    vocabulary = {g: i for i, g in enumerate(evidence())}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (grams, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in grams if g in vocabulary]] = 1.0
    y = np.zeros((len(rows), unknown + 1), np.float32)
    y[np.arange(len(rows)), [c for _, c in rows]] = 1.0
    # classes weigh alike, whatever the numbers of their rows
    share = np.array([1 / n for n in np.maximum(y.sum(axis=0), 1)], np.float32)
    importance = (y @ share)[:, None] / max(1, int((y.sum(axis=0) > 0).sum()))
    w, b = np.zeros((len(vocabulary), unknown), np.float32), np.full(unknown, -4.0, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = np.concatenate([x @ w + b, np.zeros((len(rows), 1), np.float32)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = ((p - y) * importance)[:, :unknown]
        vw, vb = 0.9 * vw - rate * (x.T @ g), 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, np.minimum(b + vb, -2.0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
    weights = {g: [round(float(v), 6) for v in w[i]] for g, i in vocabulary.items() if np.abs(w[i]).max() > 1e-4}
    return LicenseModel(families, weights, [round(float(v), 6) for v in b], [0.5] * unknown)


def train(negatives: list[str], seed: int = 7, copies: int = 12, rounds: int = 150, rate: float = 2.0, sparse: float = 1e-5, floor: float = 0.5, margin: float = 0.02) -> LicenseModel:
    """A model of some thousand n-grams from the templates and at most 2,000 paragraphs of a corpus, which may hold
    notices themselves."""
    rng = np.random.default_rng(seed)
    families = sorted(NOTICES)
    positive: list[tuple[set[str], int]] = []
    for family, text in TEMPLATES:
        words = text.split()
        for k in range(copies):
            kept = [w for w in words if k == 0 or len(words) < 4 or rng.random() > 0.15]
            positive.append((_grams(" ".join(kept)), families.index(family)))
    unknown = len(families)
    order = rng.permutation(len(negatives))
    plain = [g for g in (_grams(negatives[i]) for i in order[:2000]) if likeness(g) < 0.5]
    talk = [_grams(t) for t in [*CONFUSABLE, *OTHERS, *SHARED]]
    fit, held = [*plain[::2], *talk[::2] * 8], [*plain[1::2], *talk[1::2]]
    first = _fit([*positive, *[(g, unknown) for g in talk]], families, rounds, rate, sparse)
    # notices that are like no template are no examples of `unknown` either
    clean = lambda rows: [g for g in rows if max(_probabilities(first, g)[:-1]) < 0.9 or likeness(g) < 0.25]
    model = _fit([*positive, *[(g, unknown) for g in clean(fit)]], families, rounds, rate, sparse)
    held = clean(held)
    scores = np.array([_probabilities(model, g)[:-1] for g in held]).reshape(len(held), unknown)
    model.thresholds = [round(float(max(floor, min(0.999, top + margin))), 6) for top in (scores.max(axis=0) if len(held) else np.zeros(unknown))]
    model.false_share = 1 - 0.05 ** (1 / max(1, len(held)))
    return model


def _probabilities(model: LicenseModel, grams: Iterable[str]) -> list[float]:
    z = np.array(model.bias)
    for g in grams:
        if g in model.weights:
            z = z + np.array(model.weights[g])
    e = np.exp(np.append(z, 0.0) - max(z.max(), 0.0))
    return list(e / e.sum())


def probabilities(model: LicenseModel, text: str) -> list[float]:
    """Of each family, then of unknown; the same arithmetic as scan(), for one paragraph."""
    return _probabilities(model, _grams(text))


def judge(model: LicenseModel, text: str) -> tuple[str, float, bool]:
    """(family, probability, confirmed) of one paragraph, as scan() gives them."""
    own = probabilities(model, text)[:-1]
    k = int(np.argmax(own))
    if own[k] < model.thresholds[k]:
        return UNKNOWN, own[k], False
    return model.families[k], own[k], coverage(_grams(text), model.families[k]) >= CONFIRMED


def pattern_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, by common beginnings, so that few branches are tried at a place."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(at: dict) -> str:
        parts = [c + write(rest) for c, rest in sorted(at.items()) if c]
        if not parts:
            return ""
        own = parts[0] if len(parts) == 1 and "" not in at else f"(?:{'|'.join(parts)})"
        return own + ("?+" if "" in at else "")

    return rf"(?<![a-z0-9]){write(tree)}(?![a-z0-9])"


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def _pairs_of(words: Column) -> Column:
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def _grams_of(words: Column) -> Column:
    """The set of n-grams, as in _grams()."""
    common = F.array(*[F.lit(w) for w in sorted(COMMON)])
    content = F.filter(_pairs_of(words), lambda g: ~(F.array_contains(common, F.substring_index(g, " ", 1)) & F.array_contains(common, F.substring_index(g, " ", -1))))
    return F.array_distinct(F.concat(F.array_except(words, common), content))


def _table(spark: SparkSession, model: LicenseModel, buckets: int = 4096) -> tuple[Column, Column]:
    """Constants: the n-grams with their weights by hash, and each template's family and n-grams. An n-gram is found by
    its place, so scoring takes no longer with a larger model."""
    grams = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "g string, w array<double>")
    placed: list[list] = [[] for _ in range(buckets)]
    for r in grams.select("g", "w", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("k")).collect():  # a few thousand
        placed[r["k"]].append({"g": r["g"], "w": r["w"]})
    table = F.from_json(F.lit(json.dumps(placed)), "array<array<struct<g:string,w:array<double>>>>")
    own = F.from_json(F.lit(json.dumps([{"f": f, "g": sorted(g)} for f, g in _OWN])), "array<struct<f:string,g:array<string>>>")
    return table, own


def _score(spark: SparkSession, model: LicenseModel, paragraph: Column, buckets: int = 4096) -> Column:
    """struct(family, probability, confirmed) of one paragraph."""
    table, templates = _table(spark, model, buckets)
    names = F.array(*[F.lit(f) for f in model.families])
    limits = F.array(*[F.lit(t) for t in model.thresholds])

    def with_words(words: Column) -> Column:
        start = F.array(*[F.lit(v) for v in model.bias])
        lookup = lambda g: F.filter(F.get(table, F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")), lambda e: e["g"] == g)
        # no n-gram of common words alone is in the model, so those need not be left out first
        found = F.array_distinct(F.flatten(F.transform(F.concat(words, _pairs_of(words)), lookup)))
        total = F.aggregate(found, start, lambda a, e: F.zip_with(a, e["w"], lambda p, q: p + q))

        def verdict(z: Column) -> Column:
            top = F.greatest(F.array_max(z), F.lit(0.0))
            mass = F.aggregate(z, F.exp(-top), lambda a, v: a + F.exp(v - top))
            at = F.array_position(z, F.array_max(z)).cast("int")
            probability = F.exp(F.array_max(z) - top) / mass

            def named(family: Column) -> Column:
                def confirmed(grams: Column) -> Column:
                    share = lambda t: F.size(F.array_intersect(grams, t["g"])) / F.size(t["g"])
                    return F.array_max(F.transform(F.filter(templates, lambda t: t["f"] == family), share)) >= CONFIRMED

                return F.struct(family.alias("family"), probability.alias("probability"), let(_grams_of(words), confirmed).alias("confirmed"))

            nothing = F.struct(F.lit(UNKNOWN).alias("family"), probability.alias("probability"), F.lit(False).alias("confirmed"))
            return F.when(probability >= F.element_at(limits, at), let(F.element_at(names, at), named)).otherwise(nothing)

        return let(total, verdict)

    return let(_words(paragraph), with_words)


def sample_paragraphs(docs: DataFrame, text: str = "text", most: int = 2000) -> list[str]:
    """At most `most` paragraphs of whole documents for the unknown class, by a hash of the text."""
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")).where(F.col("text").isNotNull())
    # a share of the rows by hash first, so that the ordered sample reads a few times `most` rows however many there are
    share = max(1, rows.count() // (4 * most))
    few = rows.where(F.pmod("h", F.lit(share)) == 0).orderBy("h", "text").limit(most)
    rows = few.select(F.explode(_passages(F.col("text"))).alias("x")).select("x.p").where(F.length("p") > 20).orderBy(F.xxhash64("p"), "p").limit(most)
    return [r["p"] for r in rows.collect()]


def _passages(text: Column) -> Column:
    """Array of struct(paragraph, line, lines, p), as in passages()."""

    def of(lines: Column, k: Column) -> Column:
        entry = lambda j, n, p: F.struct(k.cast("int").alias("paragraph"), j.cast("int").alias("line"), n.cast("int").alias("lines"), p.alias("p"))
        single = F.transform(lines, lambda p, j: entry(j, F.lit(1), p))
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(STEP)), lambda j: (j == 0) | (j + STEP < F.size(lines)))
        runs = F.transform(starts, lambda j: entry(j, F.least(F.lit(RUN), F.size(lines) - j), F.array_join(F.slice(lines, j + 1, F.lit(RUN)), " ")))
        return F.when(F.size(lines) > 1, F.concat(single, runs)).otherwise(single)

    return F.flatten(F.transform(F.split(text, _BLANK), lambda paragraph, k: let(F.split(paragraph, "\n"), lambda lines: of(lines, k))))


def scan(docs: DataFrame, model: LicenseModel, text: str = "text", into: str = "licenses") -> DataFrame:
    """docs with `into`: an array of struct(paragraph, line, lines, family, probability, confirmed), one for each passage
    that the model finds a family in: a line of a paragraph, or a run of several. Null, empty and blank texts have none,
    equal rows give a row each, an empty table gives an empty table. A column of docs that is called `into` is replaced."""
    spark = docs.sparkSession
    held, scored = unused([*docs.columns, into], "passages", "scored")
    telling = model.telling_words()
    tells = lambda p: F.lower(p).rlike(pattern_of(telling)) if telling else F.lit(True)
    out = docs.withColumn(held, F.when(tells(F.col(text)), F.filter(_passages(F.col(text)), lambda x: tells(x["p"]))))
    fields = ("paragraph", "line", "lines")
    score = F.transform(held, lambda x: F.struct(*[x[f].alias(f) for f in fields], _score(spark, model, x["p"]).alias("s")))
    out = out.withColumn(scored, F.when(F.size(held) > 0, score))
    flat = F.transform(F.filter(scored, lambda x: x["s"]["family"] != UNKNOWN), lambda x: F.struct(*[x[f].alias(f) for f in fields], *[x["s"][f].alias(f) for f in ("family", "probability", "confirmed")]))
    return out.withColumn(into, F.coalesce(flat, F.array().cast("array<struct<paragraph:int,line:int,lines:int,family:string,probability:double,confirmed:boolean>>"))).drop(held, scored)


def families_of(docs: DataFrame, model: LicenseModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_candidates, n_licenses, family, probability for each row of docs: the family whose confirmed passages'
    probabilities add up to most (the last by name, if equal) and the largest of them; `unknown` with probability 0 if
    none is confirmed. Candidates are the passages in which the model finds a family, licenses those that hold a template
    too. Equal rows and null ids give a row each; an empty table gives an empty table."""
    rows = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    rows = rows.select("doc_id", F.size("licenses").cast("long").alias("n_candidates"), F.filter("licenses", lambda x: x["confirmed"]).alias("sure"))

    def weight(family: Column) -> Column:
        own = F.transform(F.filter("sure", lambda x: x["family"] == family), lambda x: x["probability"])
        return F.struct(F.round(F.aggregate(own, F.lit(0.0), lambda a, v: a + v), 9).alias("total"), family.alias("family"), F.array_max(own).alias("probability"))

    best = F.array_max(F.transform(F.array_distinct(F.transform("sure", lambda x: x["family"])), weight))
    rows = rows.withColumn("best", best)
    return rows.select("doc_id", "n_candidates", F.size("sure").cast("long").alias("n_licenses"), F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"), F.round(F.coalesce("best.probability", F.lit(0.0)), 9).alias("probability"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return families_of(docs, train(sample_paragraphs(docs)))
