"""The pipeline's rows against a plain evaluation of its stages, one after the other, on documents with planted cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import quality, tokens

from .conftest import prose
from .test_duplicates import brute_jaccard, near_copies
from .test_quality_language_license import brute as measures

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from .test_tokens_packing import brute_best_fit  # noqa: E402


@pytest.fixture(scope="module")
def planted():
    """(doc_id, text, lang) of every row, and labels (doc_id, quality)."""
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randint(52, 70)), "en") for k in range(1500)]
    for k in range(0, 1500, 50):  # good documents with a few symbols
        rows[k] = (k, rows[k][1] + " ###" * rng.randint(0, 2), "en")
    labels = [(k, 1) for k in range(1500)]
    texts = []
    texts += [prose(rng, 60) + " #" * n for n in (1, 4, 8, 12, 20, 40) for _ in range(3)]  # around the cutoff of symbols
    texts += ["\n".join([prose(rng, 12)] * 2 + [prose(rng, 9) for _ in range(n)]) for n in range(3, 12)]  # repeated lines
    texts += ["a b c d " * 40, None, "", " \n ", "123 !!! 456 " * 30, prose(rng, 20)]  # each of these goes
    texts += [prose(rng, 80)] * 9  # exact copies
    for size in (90, 200):
        texts += near_copies(rng, prose(rng, size), 25, size // 14)
    passage = prose(rng, 64)
    texts += [prose(rng, 70) + "\n\n" + passage + "  " + prose(rng, 80) for _ in range(12)]
    texts += [prose(rng, 49) + " " + " ".join(passage.split()[:49]) + " " + prose(rng, 60) for _ in range(3)]  # a word too short to be cut
    long = prose(rng, 5_000)
    texts += [long, prose(rng, 300) + " " + long[: len(long) // 3] + " " + prose(rng, 5_000)]
    rng.shuffle(texts)
    rows += [(5000 + k, t, rng.choice(["en", "fr", None])) for k, t in enumerate(texts)]
    rows += [(7000 + k, prose(rng, 60, [f"mot{j}" for j in range(300)]) + " %" * (k % 9), "fr") for k in range(60)]
    labels += [(7000 + k, int(k % 3 > 0)) for k in range(60)]
    return rows, labels


def has_letter(text):
    return text is not None and any(c.isalpha() for c in text)


def per_mille(text):
    words, chars, symbols, doubled, repeats = measures(text)
    lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    failed = words < 50 or 100 * repeats > 50 * words
    return failed, {"symbols": symbols * 1000 // max(chars, 1), "dup_lines": doubled * 1000 // max(lines, 1), "repeats": repeats * 1000 // max(words, 1)}


def good_enough(rows, labels, alpha=0.01, delta=0.05):
    good = {i for i, q in labels if q}
    seen = [(r, *per_mille(r[1])) for r in rows]
    held = [(r[2], ratios) for r, failed, ratios in seen if r[0] in good and not failed]
    large = {lang for lang, n in Counter(lang for lang, _ in held).items() if lang is not None and n >= quality.least_holdout(alpha, delta)}
    stratum = lambda lang: lang if lang in large else quality.OTHER
    strata = {stratum(lang) for lang, _ in held}
    p, cutoffs = alpha / 3, {}
    for s in strata:
        for rule in quality.RULES:
            ratios = [m[rule] for lang, m in held if stratum(lang) == s]
            n = len(ratios)
            for c in quality.CUTOFFS:
                k = sum(x > c for x in ratios)
                if k > n * p or sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > delta / (3 * len(strata)):
                    break
                cutoffs[s, rule] = c
    assert any(s == "en" for s, _ in cutoffs)
    return [r for r, failed, m in seen if not failed and all(m[x] <= cutoffs.get((stratum(r[2]), x), 1000) for x in quality.RULES)]


def one_of_each(rows):
    component, _ = brute_jaccard(rows, 5, 80)
    return [r for r, c in zip(rows, component, strict=True) if r[0] == c]


def without_repeats(texts, width=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    windows = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for text, w in zip(texts, words, strict=True):
        gone = {k + j for k in range(len(w) - width + 1) if windows[tuple(w[k : k + width])] > 1 for j in range(width)}
        parts = re.findall(r"[\x20\x09-\x0D]*$|^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        lead = parts.pop(0) if parts[0].strip(" \t\n\v\f\r") == "" else ""
        out.append(lead + "".join(p for k, p in enumerate(parts[: len(w)]) if k not in gone))
    return out


def test_rows_of_the_pipeline(spark, planted, make_docs, tmp_path):
    rows, labels = planted
    make_docs(rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lettered = [r for r in rows if has_letter(r[1])]
    good = good_enough(lettered, labels)
    single = one_of_each(good)
    assert len(rows) > len(lettered) > len(good) > len(single) > 1500
    texts = without_repeats([r[1] for r in single])
    cut = {r[0] for t, r in zip(texts, single, strict=True) if t != r[1]}
    assert len(cut) >= 14 and min(cut) >= 5000  # the planted passages, and what is left of near copies; no other document
    library, expected = tokenizers.Tokenizer.from_file(tokens.tokenizer_path()), []
    for (own, *_), text in zip(single, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            expected.append((own, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(zip(found["doc_id"], found["piece"], found["start"], found["length"], found["ids_crc32"], strict=True)) == sorted(expected)
    assert found["sequence_id"].nunique() == brute_best_fit([e[3] for e in expected], 4096)[0]
    for _, group in found.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *np.cumsum(group["length"])[:-1].tolist()] and group["length"].sum() <= 4096
