"""Spelling variants against comparing all words, whole and with keys cut finer."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import spelling


def differ_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words, times=10):
    """All words compared with all."""
    out, form = {}, {}
    for w, n in words.items():
        near = sorted(((-m, v) for v, m in words.items() if differ_by_one(w, v)))
        form[w] = near[0][1] if near and -near[0][0] >= times * n else None
        out[w] = (len(near), form[w])
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, out[w][1], root, n, out[w][0], words[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def some_words(seed, letters="abé", size=300, longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.choice([2, 3, 30, 40, 500, 6000]) for _ in range(size)}


@pytest.mark.parametrize(("most", "shard_rows"), [(50_000, 100_000), (5, 40), (1, 10_000)])
def test_equals_comparing_all(spark, most, shard_rows):
    words = some_words(most)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.group(table, most=most, shard_rows=shard_rows)) == plain(words)


def test_runs_of_equal_letters_and_chains(spark):
    words = {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaabaaa": 2000, "aaaabbaa": 20_000, "bbbbbbb": 5, "z" * 400: 3, "z" * 401: 30}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.group(table)
    assert rows_of(found) == plain(words)
    assert found.where("word = 'aaaaaaa'").first()["root"] == "aaaabbaa"


def test_odd_tables(spark):
    assert spelling.group(spark.createDataFrame([], "word string, n long")).count() == 0
    rows = [("abcdefg", 4), ("abcdefg", 6), (None, 9), ("abcdefh", None), ("", 7), ("x", 900), ("é", 3)]
    table = spark.createDataFrame(rows, "word string, n long").withColumns({c: F.lit("x") for c in ("key", "shard", "lo", "root", "a.b")})
    assert rows_of(spelling.group(table)) == plain({"abcdefg": 10, "": 7, "x": 900, "é": 3})


def test_words_of_texts(spark, make_docs, odd_rows):
    rows = [*odd_rows, (20, "Straßen STRASSENBAHN naïveté, naïveté; Élèves élèves x123456789 ÀÉÎÕÜÀÉ"), (21, "wordword " * 3000), (22, "a" * 50_000)]
    expected = Counter()
    for own, text, *_ in rows:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch <= "Z" else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
                cut = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                if len(cut) >= 7:
                    expected[cut] += 1
            run = ""
    for clash in (False, True):
        found = spelling.misspelt(make_docs(rows, clash), held=3)
        assert {r["word"]: r["n"] for r in found.collect()} == expected
