import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import language, license, quality

from .conftest import prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)


def test_base_measures(spark, make_docs, odd_rows):
    rng = random.Random(2)
    few = ["a", "b", "c#", "d*"]
    rows = [r for r in odd_rows if r[0] not in (6, 7)] + [(50 + k, "\n".join(prose(rng, rng.randint(0, 9), few) for _ in range(rng.randint(1, 12)))) for k in range(120)] + [(900, "x y\nx y\n x y\n\n\n"), (901, "a\xa0b c\x1fd e")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.assess(make_docs(rows, clash=True), labels)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in found.collect())
    expected = []
    for own, text, *_ in rows:
        m = brute(text)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        expected.append((own or -1, *m, failed, not failed))
    assert got == sorted(expected)
    assert quality.assess(make_docs([]), labels).count() == 0


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (100, 1, 0.05), (1000, 5, 0.02), (50_000, 100, 0.01), (100_000, 900, 0.01)])
def test_binomial_tail_is_exact(spark, n, k, p):
    from math import exp, lgamma, log

    direct = sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p)) for j in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    assert got == pytest.approx(direct, rel=1e-6)


def test_cutoffs_are_certified(spark, make_docs):
    """Clean documents of a stratum with enough labels stay, symbol-laden ones go; a small stratum certifies nothing."""
    rng = random.Random(3)
    rows = [(k, prose(rng, 60), "en") for k in range(3000)] + [(10_000 + k, prose(rng, 60).replace(" ", " ### "), "en") for k in range(200)] + [(20_000 + k, prose(rng, 60).replace(" ", " ### "), "fr") for k in range(20)] + [(30_000 + k, prose(rng, 60), "fr") for k in range(20)]
    labels = spark.createDataFrame([(r[0], int("###" not in r[1]), 0) for r in rows] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.assess(make_docs(rows), labels).groupBy((F.col("doc_id") / 10_000).cast("int").alias("g")).agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["g"]: r["kept"] for r in found.collect()}
    assert kept[0] == 1 and kept[1] == 0 and kept[2] == 1 and kept[3] == 1
    stage = quality.keep_good(make_docs(rows, clash=True), labels)
    assert stage.columns == make_docs(rows, clash=True).columns and stage.count() == 3040


def test_small_strata_are_pooled(spark, make_docs):
    """Strata with too few labels for any cutoff share one; there is no bound on the number of strata."""
    rng = random.Random(33)
    rows = [(k, prose(rng, 60), f"lang{k % 90}") for k in range(3000)] + [(10_000 + k, prose(rng, 60).replace(" ", " ### "), f"lang{k}") for k in range(90)]
    labels = spark.createDataFrame([(r[0], int("###" not in r[1]), 0) for r in rows], "doc_id long, quality int, toxic int")
    found = quality.assess(make_docs(rows), labels)
    assert {r[0] for r in found.select("stratum").distinct().collect()} == {"other"}
    assert found.where("kept").agg(F.max("doc_id"), F.count("*")).first()[:] == (2999, 3000)


def plain_cutoffs(sizes, above, alpha=0.01, delta=0.05):
    """{stratum: cutoff of the rule on symbols}, and the strata, by trying every number of strata from the most on."""
    values = sorted((v for v in sizes if v is not None), key=lambda v: (-sizes[v], v))
    for s in range(len(values), -1, -1):
        chosen = values[:s]
        strata = s + (sum(sizes.values()) > sum(sizes[v] for v in chosen))
        if all(sizes[v] >= quality.least_holdout(alpha, delta / strata) for v in chosen):
            break
    out, p = {}, alpha / 3
    for own in [*chosen, None]:
        members = [own] if own else [v for v in sizes if v not in chosen]
        n = sum(sizes[v] for v in members)
        for c in quality.CUTOFFS:
            k = sum(x > c for v in members for x in above[v])
            if k > n * p or sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > delta / (3 * strata):
                break
            out[own] = c
    return set(chosen), out


@pytest.mark.parametrize("sizes", [{"a": 1700, "b": 1500, "other": 1300}, {"a": 1700, "b": 1600, "other": 1580}, {"a": 1700, "b": 1600, "other": 1640, None: 5}, {"a": 1300, "b": 1300, "c": 30}, {"a": 1250, None: 100}])
def test_as_many_strata_as_can_be_certified(spark, sizes):
    """No value is split off that its level leaves without a cutoff; a value called as the pool is none of it."""
    above = {v: [800 - 100 * k for k in range(3)] if n > 1400 else [] for v, n in sizes.items()}
    rows = [(v, above[v][k] if k < len(above[v]) else 0, 0, 0) for v, n in sizes.items() for k in range(n)]
    held = spark.createDataFrame(rows, "stratum_value string, symbols long, dup_lines long, repeats long")
    strata, expected = plain_cutoffs(sizes, above)
    chosen = quality.chosen_strata(held, 0.01, 0.05)
    assert {r["stratum"] for r in chosen.collect()} == strata
    found = quality.thresholds(held.join(chosen, F.col("stratum_value") == F.col("stratum"), "left"))
    assert {r["stratum"]: r["symbols_cutoff"] for r in found.collect() if r["symbols_cutoff"]} == expected and expected


def test_certified_cutoffs_equal_sql(spark):
    """On a table with labels enough that cutoffs are certified, and reject documents that the base rules keep."""
    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        place = f"{folder}/{t}.parquet"
        duck.execute(f"create view {t} as select * from '{place + '/*.parquet' if os.path.isdir(place) else place}'")
    own = quality.op1_quality_rules(spark, folder)
    columns = sorted(own.columns)
    found = sorted(map(tuple, own.select(*columns).collect()))
    assert found == sorted(duck.sql(quality.OP1_SQL).select(*columns).fetchall())
    kept, failed = columns.index("kept"), columns.index("base_failed")
    assert any(not r[kept] and not r[failed] for r in found)


def test_false_rejections_stay_below_the_level(spark):
    """With 1.5 % of good documents above every cutoff and alpha 1 %, no cutoff is certified."""
    hold = spark.range(20_000).select(F.lit("en").alias("stratum"), F.when(F.col("id") % 67 == 0, 950).otherwise(0).alias("symbols"), F.lit(0).alias("dup_lines"), F.lit(0).alias("repeats"))
    row = quality.thresholds(hold).first()
    assert row["symbols_cutoff"] is None and row["dup_lines_cutoff"] == quality.CUTOFFS[-1]


def brute_phrases(sample, text):
    count = at = 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += max(1, n)
        count += 1
    return count


def test_automaton_parses_greedily():
    rng = random.Random(4)
    for dense in (1 << 23, 0):
        for _ in range(40):
            texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 3))]
            alphabet = language.Alphabet([texts])
            kind = type("Kind", (language.SuffixAutomaton,), {"DENSE": dense})
            automaton = kind([alphabet.codes(t) for t in texts], alphabet.width)
            for _ in range(20):
                text = "".join(rng.choice("ab cz") for _ in range(rng.randint(1, 30)))
                assert automaton.phrases(alphabet.codes(text)) == brute_phrases("\n".join(texts), text), (texts, text)


def test_texts_in_step_parse_alike():
    """Many texts at once, of all lengths, against one by one; dense and sparse automata, few texts and none."""
    rng = random.Random(14)
    samples = [(lang, ["".join(rng.choice("abc dé") for _ in range(rng.randint(1, 400))) for _ in range(3)]) for lang in ("x", "y", "z")]
    parser = language.Parser(samples)
    for n in (0, 1, 63, 64, 65, 400):
        texts = ["".join(rng.choice("abc dé\U0001d4b3z") for _ in range(rng.choice([0, 1, 5, 80, 3000 if n < 400 else 200]))) for _ in range(n)] + [None, "", "1 2"]
        one_by_one = []
        for t in texts:
            own = language.normalise(t or "")
            one_by_one.append(parser._choose([a.phrases(parser.alphabet.codes(own)) for a in parser.automata], len(own)) if own else ("und", 0.0))
        assert parser.predict(texts) == one_by_one and parser.predict(texts, most=500) == one_by_one


def test_a_wide_script_does_not_widen_other_languages():
    """Han beside Latin; and 200 labels in less than a gigabyte, with the same counts."""
    rng = random.Random(15)
    latin = [("x%03d" % k, ["".join(rng.choice("abcdefghij klmnop") for _ in range(2000))]) for k in range(200)]
    han = ("han", ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000))])
    parser = language.Parser([*latin[:3], han])
    assert all(a.keys is None and len(a.step) < 4 * 2002 * 20 for a in parser.automata[:3])
    kind = type("Small", (language.Parser,), {"BUDGET": 1 << 20})
    packed, flat = kind(latin), language.Parser(latin)
    assert all(a.keys is not None for a in packed.automata) and sum(a.keys.nbytes + a.targets.nbytes for a in packed.automata) < 200 * 3 * 2002 * 16
    texts = ["".join(rng.choice("abcdefghij klmnopq") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    assert packed.predict(texts) == flat.predict(texts)


def test_one_very_long_text_in_the_sample(spark, make_docs):
    """No more of it than the bound says comes to the driver."""
    learned = next(k for k in range(100, 200) if zlib.crc32(b"%d" % k) % 4 != 2)
    docs = make_docs([(k, "ab cd ef " * 20, "x") for k in range(20)] + [(learned, "gh ij " * 2_000_000, "y")])
    found = dict(language.sample_texts(docs, letters=1000))
    assert set(found) == {"x", "y"} and len(found["y"][0]) <= 2000


LANGS = {"en": ["the", "thing", "with", "another", "house", "under"], "de": ["der", "schön", "über", "nicht", "haus", "zwischen"], "fr": ["être", "dans", "maison", "où", "leçon", "avec"]}


def test_languages(spark, make_docs, odd_rows):
    rng = random.Random(5)
    rows = [(k, prose(rng, 30, LANGS[lang]), lang) for k, lang in enumerate(rng.choices(list(LANGS), k=300))]
    found = language.identify(make_docs([*rows, *[(1000 + r[0], r[1], None) for r in odd_rows if r[0]], (None, "das Haus", None), (1020, "² ³ ½ 5", None), (1021, "x²", None)], clash=True))
    got = {r["doc_id"]: r for r in found.collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 40 and all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003, 1010, 1012, 1020)) and got[1021]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert language.identify(make_docs([])).count() == 0
    blind = language.identify(make_docs([(r[0], r[1], None) for r in rows]))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}


def test_prediction_looks_at_text_alone(spark, make_docs):
    rng = random.Random(6)
    rows = [(k, prose(rng, 30, LANGS[lang]), lang) for k, lang in enumerate(rng.choices(list(LANGS), k=120))]
    samples = language.sample_texts(make_docs(rows))
    a = language.classify(make_docs(rows), samples).select("doc_id", "lang_pred", "score")
    b = language.classify(make_docs([(r[0], r[1], "xx") for r in rows]), samples).select("doc_id", "lang_pred", "score")
    assert a.exceptAll(b).count() == 0


@pytest.fixture(scope="module")
def plain():
    rng = random.Random(7)
    return [prose(rng, 40) for _ in range(300)]


@pytest.fixture(scope="module")
def model(plain):
    return license.train(plain)


#: Notices that are no templates.
OTHERS = [
    ("CC-BY-SA", "Distributed under CC BY-SA 4.0"), ("CC-BY", "Terms: Creative Commons Attribution 4.0 International."), ("BSD", "BSD-3-Clause"), ("Unlicense", "Released into the public domain as free and unencumbered software."),
    ("GPL", "Licensed under the GNU General Public License version 2 or any later version"), ("AGPL", "This server is licensed under the GNU Affero General Public License, version 3"), ("MIT", "This package is under the MIT License"),
    ("Apache-2.0", "Code is licensed under the Apache License, Version 2.0"), ("LGPL", "Released under the GNU Lesser General Public License version 3"), ("MPL-2.0", "Subject to the terms of the Mozilla Public License 2.0"),
    ("EPL", "Made available under the terms of the Eclipse Public License 2.0"), ("ISC", "This package is released under the ISC License"), ("CC0", "The data are dedicated to the public domain under CC0 1.0 Universal"), ("MIT", "AS IS: the software is provided without warranty of any kind, express or implied, including the warranties of merchantability, fitness for a particular purpose and noninfringement"),
]


def test_licenses(spark, make_docs, odd_rows, plain, model):
    """Families of templates and of other notices, against plain arithmetic for each line."""
    rows = [(100 + k, f"{plain[k]}\n{text}\n{plain[k + 1]}") for k, (_, text) in enumerate(license.TEMPLATES)]
    clean = [(500 + k, t) for k, t in enumerate(["The license plate was stolen.", "Permission to land was granted.", "a fishing licence costs money"])]
    others = [(600 + k, f"{plain[k]}\n\n \n{text}") for k, (_, text) in enumerate(OTHERS)]
    every = [*rows, *odd_rows, *clean, *others]
    docs = make_docs(every, clash=True)
    got = {r["doc_id"]: r for r in license.families_of(docs, model).collect()}
    right = sum(got[100 + k]["family"] == f for k, (f, _) in enumerate(license.TEMPLATES))
    assert right == len(license.TEMPLATES)
    assert sum(got[600 + k]["family"] == f for k, (f, _) in enumerate(OTHERS)) >= len(OTHERS) - 1
    assert all(got[i]["family"] == license.UNKNOWN for i, _ in clean) and got[1]["family"] == license.UNKNOWN and got[1]["n_candidates"] == 0
    for row in license.scan(docs, model).collect():
        expected = [(k, line, lines, *license.judge(model, p)) for k, line, lines, p in license.passages(row["text"] or "")]
        expected = [e for e in expected if e[3] != license.UNKNOWN]
        assert [(x["paragraph"], x["line"], x["lines"], x["family"], x["confirmed"]) for x in row["licenses"]] == [(*e[:4], e[5]) for e in expected]
        assert all(x["probability"] == pytest.approx(e[4], abs=1e-9) for x, e in zip(row["licenses"], expected, strict=True))
    assert license.families_of(make_docs([]), model).count() == 0
    named = docs.withColumn("lines", F.lit(1)).withColumn("a.b", F.lit(2))
    assert license.scan(named, model).columns == [*named.columns, "licenses"]


#: Notices as they stand in files: wrapped, with comment signs, several paragraphs, heads of whole licence texts.
FILES = {
    "MIT": """Copyright (c) 2021 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU General Public License for more details.""",
    "LGPL": """   This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation; either
   version 2.1 of the License, or (at your option) any later version.

   This library is distributed in the hope that it will be useful,
   but WITHOUT ANY WARRANTY; without even the implied warranty of
   MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
   Lesser General Public License for more details.""",
    "AGPL": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}
HEADS = [
    ("GPL", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed."),
    ("AGPL", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed."),
    ("LGPL", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed."),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"),
]
NOBODYS = [
    "You may not use this file except in compliance with the License.", "This program is free software: you can redistribute it and/or modify", "The software is licensed to you by Contoso under a commercial license agreement",
    "Boost your immune system now with version 1.0", "Apache web server, version 2.0, and a license plate reader", "Licensed under GPL v2", "Academic Free License", "Licensed under the Open Publication License, v1.0 or later",
    "Everyone is permitted to copy and distribute verbatim copies of this license document", "The museum of modern art is open to the public", "See LICENSE for details", "Copyright 2020. All rights reserved.",
]


def test_notices_as_they_stand_in_files(spark, make_docs, plain, model):
    """Real notices are named right wherever they stand, and what names no family here is unknown."""
    rng = random.Random(8)
    named = [(1000 + k, f, t) for k, (f, t) in enumerate([*FILES.items(), *HEADS])]
    named += [(2000 + k, f, f"{prose(rng, 30)}\n{prose(rng, 9)}\n{t}\n{prose(rng, 200)}") for k, (f, t) in enumerate([*FILES.items(), *HEADS])]
    none = [(3000 + k, "unknown", t) for k, t in enumerate(NOBODYS)] + [(4000 + k, "unknown", f"{plain[k]}\n\n{t}") for k, t in enumerate(NOBODYS)]
    got = {r["doc_id"]: r["family"] for r in license.families_of(make_docs([(k, t) for k, _, t in [*named, *none]]), model).collect()}
    assert {k: got[k] for k, *_ in [*named, *none]} == {k: f for k, f, _ in [*named, *none]}


def test_passages_cover_every_line():
    text = "\n".join(["a", "b", " * ", "", *[f"line {k}" for k in range(40)], "---", "é", "z"])
    found = license.passages(text)
    assert [p for *_, n, p in found if n == 1 and p in "abz"] == ["a", "b", "z"] and sum(n == 1 for *_, n, _ in found) == 43
    runs = [(k, j, n) for k, j, n, _ in found if n > 1]
    assert runs == [(0, 0, 2), (1, 0, 16), (1, 8, 16), (1, 16, 16), (1, 24, 16)]
    assert license.passages("") == [(0, 0, 1, "")]


def test_evidence_is_of_one_family():
    grams = set(license.evidence())
    for f, own in license._OWN:
        assert not any(g in grams for g in own if any(g in other for h, other in license._OWN if h != f)) and own & grams


def test_notices_in_the_sample_are_no_negatives(plain, model):
    poisoned = license.train(plain[:180] + ["Released under the MIT License."] * 60 + ["Licensed under the Apache License, Version 2.0."] * 60)
    for line, family in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
        assert license.judge(poisoned, line)[0] == license.judge(model, line)[0] == family
    assert poisoned.false_share < 0.05


def test_words_that_every_notice_holds(plain, model):
    """Without a telling word no paragraph reaches a threshold, whatever else of the vocabulary it holds."""
    telling = set(model.telling_words())
    rest = [g for g in model.weights if not telling & set(g.split())]
    for k, t in enumerate(model.thresholds):
        z = model.bias[k] + sum(max(0.0, model.weights[g][k]) for g in rest)
        assert 1 / (1 + 2.718281828459045**-z) < t
    assert telling and not telling & license.COMMON


def test_language_is_the_one_with_the_fewest_phrases(spark, make_docs):
    """Whole texts across words, against a parse by plain search in the sample."""
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(1, 40), LANGS[lang] + LANGS["en"][:2]) + rng.choice(["", " 7, ", "ß"]), lang) for k, lang in enumerate(rng.choices(list(LANGS), k=150))]
    docs = make_docs(rows, clash=True)
    samples = language.sample_texts(docs, letters=900)
    got = {r["doc_id"]: r for r in language.classify(docs, samples).collect()}
    import math

    for k, text, _ in rows:
        own = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        bits = sorted((brute_phrases("\n".join(texts), own) * math.log2(sum(map(len, texts))) / len(own), lang) for lang, texts in samples)
        assert got[k]["lang_pred"] == bits[0][1] and got[k]["score"] == pytest.approx(1 - bits[0][0] / bits[1][0], abs=1e-12)


def test_language_sample_is_whole(spark, make_docs):
    """60,000 letters are learned where there are as many."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    ((lang, texts),) = language.sample_texts(make_docs([(k, prose(rng, 200, words)) for k in range(120)]))
    assert lang == "en" and 60_000 <= sum(map(len, texts)) < 70_000


def test_language_sample_is_first_by_hash(spark, make_docs):
    """The first ids by hash, one document for each, though one id is repeated very often and others are null."""
    rows = [(k, f"word number {k}", "en" if k % 3 else "de") for k in range(30_000)] + [(7, "again and again", "en")] * 5000 + [(None, f"none {k}", "fr") for k in range(50)]
    docs = make_docs(rows)
    samples = dict(language.sample_texts(docs, letters=10**6, per_lang=20))
    ids = spark.range(30_000).select("id", F.xxhash64("id", F.lit(1)).alias("h"), language.remainder("id").alias("r")).where("r != 2").orderBy("h").collect()
    for lang, rest in (("en", (1, 2)), ("de", (0,))):
        first = [r["id"] for r in ids if r["id"] % 3 in rest][:20]
        assert samples[lang] == [language.normalise("again and again" if k == 7 else f"word number {k}") for k in first]
    assert samples["fr"] == [" none "]
