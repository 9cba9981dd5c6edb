import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import embedding, fm_index, graph, jaccard, substring

from .conftest import prose


def brute_components(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 260), (30, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        chain = [(1000 + k, 1001 + k) for k in range(70)]
        star = [(5000, 5001 + k) for k in range(90)]
        every = pairs + chain + star
        found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(every, "a long, b long").repartition(5)).collect()}
        nodes = sorted({x for p in every for x in p if p[0] != p[1]})
        expected = dict(zip(nodes, brute_components(nodes, [(nodes.index(a), nodes.index(b)) for a, b in every if a != b]), strict=True))
        assert found == expected


def sets_of(rows, width):
    out = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    return out


def brute_jaccard(rows, width, percent):
    sets = sets_of(rows, width)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return brute_components([r[0] for r in rows], links), [len(s) for s in sets]


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words[: len(words) - rng.randint(0, 3)]))
    return out


@pytest.fixture(scope="module")
def copies(odd_rows):
    rng = random.Random(8)
    passage = prose(rng, 60)
    texts = []
    for size in (20, 80, 200):
        texts += near_copies(rng, prose(rng, size), 40, size // 16)
    texts += [prose(rng, 50) + " " + passage + " " + prose(rng, 30) for _ in range(40)]
    texts += [passage.upper(), passage, "x y z", "X Y  z", "x y z w"]
    rng.shuffle(texts)
    return [r for r in odd_rows if r[0] not in (6, 7)] + [(100 + k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"block": 2000, "salt_from": 3, "most_often": 5, "bucket_bytes": 20_000}])
def test_jaccard_is_exact(spark, make_docs, copies, options):
    docs = make_docs(copies, clash=True).repartition(6)
    found = jaccard.components_of(docs, 4, 85, **options).collect()
    expected, sizes = brute_jaccard(copies, 4, 85)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)
    assert got == Counter((r[0], n, r[0] if not n else c) for r, n, c in zip(copies, sizes, expected, strict=True))


def test_jaccard_of_nothing(spark, make_docs):
    assert jaccard.components_of(make_docs([])).count() == 0
    assert jaccard.keep_one(make_docs([])).count() == 0
    assert jaccard.components_of(make_docs([(1, None)])).first()["component_id"] == 1


def test_keep_one(spark, make_docs, copies):
    docs = make_docs(copies, clash=True).withColumns({"_row": F.lit(1), "a.b": F.lit(2)})
    kept = jaccard.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns and kept.where("_row != 1 or `a.b` != 2").count() == 0
    expected, sizes = brute_jaccard(copies, 4, 85)
    groups = {c for c, n in zip(expected, sizes, strict=True) if n and c is not None}
    blank = sum(1 for n in sizes if not n)
    named = [r["doc_id"] for r in kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).collect()]
    assert sorted(x for x in named if x is not None) == sorted(groups) and kept.count() == len(named) + blank


@pytest.mark.parametrize("edits", [2, 12, 30])
def test_group_join_derives_answers(edits):
    rng = random.Random(9)
    texts = near_copies(rng, prose(rng, 120), 400, edits)
    sets = {jaccard.set_id(s): s for s in jaccard.shingle_sets([t.encode() for t in texts], 4)}
    names = list(sets)
    join = jaccard.GroupJoin(names, [sets[n] for n in names], 85)
    links = join.links()
    index = {n: i for i, n in enumerate(names)}
    every = [(i, j) for i in range(len(names)) for j in range(i) if 185 * len(np.intersect1d(sets[names[i]], sets[names[j]])) >= 85 * (len(sets[names[i]]) + len(sets[names[j]]))]
    ids = list(range(len(names)))
    assert brute_components(ids, [(index[a], index[b]) for a, b in links]) == brute_components(ids, every) and len(links) < len(names)
    assert join.looked + join.derived == len(names) and join.derived > (len(names) // 8 if edits == 2 else 0)


def test_skipped_blocks_hold_no_links():
    rng = np.random.default_rng(2)
    size, pos = rng.integers(5, 60, 400), rng.integers(0, 8, 400)
    order = np.lexsort((pos, size))
    size, pos = size[order], pos[order]
    blocks = jaccard.Blocks(size, pos, 80)
    for s, p in ((20, 0), (33, 5), (59, 2), (6, 1)):
        for larger in (False, True):
            need = -(-80 * (size + s) // 180)
            fits = (np.minimum(size - pos, s - p) >= need) & (100 * size >= 80 * s) & ((80 * size <= 100 * s) if larger else (size <= s))
            assert blocks.open(s, p, larger=larger).tolist() == np.flatnonzero(fits).tolist()
    assert (blocks.open(33, 0, upto=100) < 100).all()


def test_one_shingle_in_all_documents(spark, make_docs):
    """A common line is in every document; only near copies link."""
    rng = random.Random(21)
    line = "this very line is in all of them"
    rows = [(k, line + " " + prose(rng, 30)) for k in range(600)]
    rows += [(1000 + k, rows[k][1]) for k in range(50)] + [(2000 + k, rows[k][1].replace("w1", "w2", 1)) for k in range(50)]
    found = jaccard.components_of(make_docs(rows).repartition(7), 4, 85, salt_from=100).collect()
    expected, sizes = brute_jaccard(rows, 4, 85)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == Counter((r[0], n, c) for r, n, c in zip(rows, sizes, expected, strict=True))


def test_thin_shingles_are_found(spark, make_docs):
    """A shingle once in each of many runs of batches is known to be frequent, as are others in proportion."""
    rng = random.Random(18)
    docs = make_docs([(k, prose(rng, 40) + " seen in every run") for k in range(64)]).repartition(64).withColumn("row", F.col("doc_id"))
    (common,) = next(jaccard.shingle_sets([b"seen in every run"], 4)).view(np.int64).tolist()
    for one_in in (1, 4):
        sets = jaccard._sets(docs, 4, one_in)
        assert sets.where("kind = 0").count() == 64 and sets.where("kind = 1").count() == 0
        found = {r["set"]: r["n"] for r in jaccard._frequent(sets, one_in).collect()}
        assert set(found) == {common} and (found[common] == 64 if one_in == 1 else 20 <= found[common] <= 140)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)) for n in (1, 40, 127, 128, 300, 2000, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, 3, dtype=np.int64).astype(np.uint64)])) for s in sets]
    bits = [jaccard.parity_bits(s) for s in sets]
    maps = jaccard.Bitmaps(np.array([len(b) for b in bits]), np.concatenate(bits))
    x, y = np.triu_indices(len(sets), 1)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)])
    assert (maps.differ(x, y) <= real).all() and (maps.differ(x, x) == 0).all()


# --- substrings -------------------------------------------------------------------------------------------------


def brute_repeats(rows, width):
    words = [(r[1] or "").encode().split() for r in rows]
    count = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def passages(odd_rows):
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (30, 35, 36, 50, 90)]
    rows = [r for r in odd_rows if r[0] not in (6, 7)]
    for k in range(90):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(shared).split()
            a = rng.randint(0, 4)
            parts += [" ".join(own[a : len(own) - rng.randint(0, 3)]), prose(rng, rng.randint(0, 20))]
        rows.append((100 + k, rng.choice([" ", "\n", "\t "]).join(parts)))
    return [*rows, (900, "the the " * 100), (901, "a b c " * 60), (902, prose(rng, 34)), (903, "Case case " + shared[4].upper())]


@pytest.mark.parametrize("hot_from", [20_000, 3])
def test_substrings_are_exact(spark, make_docs, passages, hot_from):
    docs = make_docs(passages, clash=True).repartition(5)
    found = substring.dedup(docs, 35, hot_from=hot_from).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == Counter(brute_repeats(passages, 35))


def test_cut_texts(spark, make_docs, passages):
    docs = make_docs(passages, clash=True).withColumns({"_row": F.lit(1), "_marks": F.lit(1), "a.b": F.lit(2)})
    found = substring.cut_repeats(docs, 35)
    assert found.columns == docs.columns
    got = Counter((r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in found.collect())
    assert got == Counter((i, h) for i, _, _, h in brute_repeats(passages, 35))
    same = found.join(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")), F.col("doc_id") == F.col("i")).where("doc_id = 902 and text = t")
    assert same.count() == 1


def test_one_passage_in_all_documents(spark, make_docs):
    rng = random.Random(31)
    passage = prose(rng, 60)
    rows = [(k, prose(rng, rng.randint(0, 40)) + " " + passage + " " + prose(rng, 20)) for k in range(500)]
    found = substring.dedup(make_docs(rows).repartition(5), 35, hot_from=100_000).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == Counter(brute_repeats(rows, 35))


def test_substrings_of_nothing(spark, make_docs):
    assert substring.dedup(make_docs([])).count() == 0 and substring.cut_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_counts(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(3, 30, 60)
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    for s, n in zip(starts, lengths, strict=True):
        text[s : s + n] = rng.integers(1, 4, n)
    times = rng.integers(1, 3, len(lengths)) if seed % 2 else np.ones(len(lengths), int)
    index = fm_index.FMIndex(text, 32, np.repeat(times, lengths + 1))
    width = 6
    use = np.flatnonzero(lengths >= width)
    masks = fm_index.repeated_windows(index, text, starts[use], lengths[use] - width + 1, width)
    count = Counter()
    for s, n, t in zip(starts, lengths, times, strict=True):
        for k in range(n - width + 1):
            count[tuple(text[s + k : s + k + width])] += t
    for m, s, n in zip(masks.tolist(), starts[use], lengths[use], strict=True):
        assert m == sum(1 << k for k in range(n - width + 1) if count[tuple(text[s + k : s + k + width])] > 1)


def test_covered():
    marks = [np.array([(2, 0b1011), (20, 1)], substring._MARK).tobytes()]
    assert np.flatnonzero(substring.covered(30, marks, 3)).tolist() == [2, 3, 4, 5, 6, 7, 20, 21, 22]


# --- vectors ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"block": 30}, {"block": 30, "whole": 40}])
def test_vectors(spark, options):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, *[base[i] + rng.normal(size=(40, 32)) * 0.12 for i in (1, 2)], rng.normal(size=(150, 32))]))]
    rows += [(1000, rows[3][1]), (1001, [2 * x for x in rows[3][1]]), (1002, rows[3][1]), (1002, rows[3][1]), (None, rows[4][1])]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [float("inf"), *[1.0] * 31]), (2005, [None, *[1.0] * 31]), (2006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows, *bad]], "vec_id long, embedding array<float>, label int, key string")
    found = embedding.near_duplicates(df, 0.9, recall=0.9999, **options).collect()
    v = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    close = v @ v.T >= 0.9
    links = [(i, j) for i in range(len(rows)) for j in range(i) if close[i, j]]
    classes = brute_components([r[0] for r in rows], links)
    expected = Counter((r[0], int(close[k].sum()) - 1, classes[k]) for k, r in enumerate(rows)) + Counter((i, 0, i) for i, _ in bad)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == expected
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_no_vectors(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["component_id"] == 1


def test_recall_of_vectors(spark):
    """50,000 vectors, 4,000 planted pairs just above the threshold, against brute force."""
    rng = np.random.default_rng(12)
    n, dim = 46_000, 64
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(4000, dim))
    side -= (side * base[:4000]).sum(axis=1)[:, None] * base[:4000]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.9005, 0.91, 4000)[:, None]
    v = np.concatenate([base, cosine * base[:4000] + np.sqrt(1 - cosine**2) * side])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": list(v)}))
    found = embedding.near_duplicates(df, 0.9, recall=0.995).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    links = 0
    for a in range(0, len(v), 2000):
        links += int((v[a : a + 2000] @ v.T >= 0.9).sum())
    links = (links - len(v)) // 2
    assert links >= 4000 and 0.99 <= found.sum() / 2 / links <= 1


def test_pairs_of_vectors_grow_less_than_their_square():
    """Pairs that share a cell, over all tables, at the sizes at which all pairs were counted before (power 2.0)."""
    rng, pairs = np.random.default_rng(8), []
    for n in (10_000, 50_000):
        v = rng.normal(size=(n, 64))
        plan = embedding.Plan(n, 0.9, 0.995)
        cells = plan.cells(v / np.linalg.norm(v, axis=1)[:, None])
        pairs.append(sum(int((np.unique(cells[:, t], return_counts=True)[1] ** 2).sum()) for t in range(plan.tables)))
    assert math.log(pairs[1] / pairs[0]) / math.log(5) < 1.6


def test_buckets_of_lists_hold_what_they_should(spark):
    """As many buckets as keep each under its bytes, counted once for every set that a bucket holds."""
    from gridloom.llm import jaccard

    sizes = [1, 50, 600, 600, 6000, 20_000]
    sets = spark.createDataFrame([(n,) for n in sizes], "n_shingles long")
    for each in (200, 5_000, 80_000, 10**9):
        b = jaccard._buckets(sets, 80, 4, each)
        held = lambda b: sum(20 * k + (16 + n / 8) * b * (1 - math.exp(-k / b)) for n in sizes for k in [n - math.ceil(n * 80 / 100) + 1])
        assert held(b) <= b * each and (b == 4 or held(b // 2) > b // 2 * each)
    assert jaccard._buckets(sets.limit(0), 80, 64, 1000) == 64
