"""Fingerprints against a plain evaluation, and their likeness against the exact one."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import fingerprint
from gridloom.llm.common import mix, shingle_hashes

from .conftest import prose


def plain_sketch(text, bins=256, bits=4, width=5):
    """Bin by bin: the least hash, or what the first bin that holds one lends."""
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return ""
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    hashes = {int(h) for h in shingle_hashes(own, min(width, len(words)))}
    held = {}
    for h in hashes:
        b = h * bins >> 64
        held[b] = min(h, held.get(b, h))
    out = 0
    for i in range(bins):
        order = sorted(range(bins), key=lambda b: int(mix(np.array([i * bins + b + 1], np.uint64))[0])) if i not in held else [i]
        out = out << bits | held[next(b for b in order if b in held)] & (1 << bits) - 1
    return f"{out:0{bins * bits // 4}x}"


def shingle_set(text, width=5):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_sketches_equal_the_plain_ones(odd_rows):
    rng = random.Random(1)
    texts = [r[1] for r in odd_rows] + [prose(rng, n) for n in (1, 4, 5, 6, 20, 300, 2000)] + ["Some Words HERE", "some words here"]
    sketcher = fingerprint.Sketcher()
    for t in texts:
        assert sketcher.of(None if t is None else t.encode()).hex() == plain_sketch(t)
    for bins, bits in ((64, 1), (64, 2), (32, 8)):
        other = fingerprint.Sketcher(bins, bits)
        for t in texts[-6:]:
            assert other.of(t.encode()).hex() == plain_sketch(t, bins, bits)
    with pytest.raises(ValueError):
        fingerprint.Sketcher(100)


@pytest.mark.parametrize(("bins", "bits"), [(256, 4), (1024, 1), (512, 2), (256, 8)])
def test_likeness_is_near_the_exact_one(bins, bits):
    """No bias at any likeness: neither from few shingles (most bins borrow) nor from equal low bits by chance."""
    rng = random.Random(bins + bits)
    sketcher = fingerprint.Sketcher(bins, bits)
    for size in (40, 400, 3000):
        for keep in (0.0, 0.5, 0.8, 0.95):
            errors, exact = [], 0
            for _ in range(30):
                words = [f"w{rng.random()}" for _ in range(size)]
                other = words[: int(keep * size)] + [f"v{rng.random()}" for _ in range(size - int(keep * size))]
                a, b = " ".join(words), " ".join(other)
                x, y = shingle_set(a), shingle_set(b)
                exact = len(x & y) / len(x | y)
                errors.append(fingerprint.estimate([(sketcher.of(a.encode()), sketcher.of(b.encode()))], bits)[0] - exact)
            assert abs(np.mean(errors)) < 0.05 + 0.1 * (size == 40), (size, keep)
            assert np.sqrt(np.mean(np.square(errors))) < 0.09 + 0.12 * (size == 40)


def test_edited_texts_equal_a_plain_evaluation(spark, make_docs):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.choice([0, 1, 3, 8, 60, 500]))) for k in range(-5, 60)] + [(100, None), (101, "é" * 7), (102, "\U0001f600 a b c d e f"), (103, prose(rng, 20_000)), (None, "no id")]
    rng.shuffle(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    expected = {}
    for k, (own, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        prints = [plain_sketch(t) for t in (text, edited, after)]
        near = fingerprint.estimate([(bytes.fromhex(prints[0]), bytes.fromhex(p)) for p in prints[1:]], 4)
        expected[own] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], *near)
    for clash in (False, True):
        found = fingerprint.compare_edited(make_docs(rows, clash).repartition(5))
        assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == expected
        assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_odd_tables(spark, make_docs, odd_rows):
    found = fingerprint.compare_edited(make_docs(odd_rows))
    assert found.count() == len(odd_rows)
    prints = {r["doc_id"]: r for r in found.collect()}
    assert prints[4]["fingerprint"] == prints[5]["fingerprint"] and prints[8]["fingerprint"] == prints[9]["fingerprint"]
    assert prints[1]["fingerprint"] == "" and prints[1]["near_edited"] == 1.0 and prints[1]["n_chars"] == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found.collect())
    assert fingerprint.compare_edited(make_docs(odd_rows).limit(0)).count() == 0
    alone = fingerprint.compare_edited(make_docs([(1, "abcdef")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0


def test_plain_fingerprints_and_likeness_column(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    found = fingerprint.fingerprints(docs)
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["fingerprint"]) for r in found.collect()) == sorted((r[0] or -1, len(r[1] or ""), plain_sketch(r[1])) for r in odd_rows)
    both = found.alias("a").join(found.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), fingerprint.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("near"), fingerprint.likeness(F.lit(None).cast("string"), F.col("b.fingerprint")).alias("none"))
    near = {(r["a"], r["b"]): r["near"] for r in both.collect()}
    assert near[4, 5] == 1.0 and near[1, 2] == 1.0 and near[1, 4] == 0.0 and near[6, 7] > 0.95 and near[4, 6] < 0.1
    assert {r["none"] for r in both.collect()} == {None}
