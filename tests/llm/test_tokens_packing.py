import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import packing, token_counts, tokens

from .conftest import prose

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.tokenizer_path())


TRICKY = ["", " ", "a", "Foo, bar.  Baz!?\n\nqux", "İ, ǅ. ﬁ ΣΑΣ, ß.", "don't it's WE'LL", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>,", "12,345.67", "日本語 テキスト。", "a b c\x85d\x1ce", "é é, ́, x́.", "......", "​ , ", "x" * 5000]


def test_encoder_matches_library(library):
    encoder = tokens.Encoder(tokens.tokenizer_path(), 50)
    assert encoder.separable
    rng = random.Random(1)
    parts = [w for t in TRICKY for w in t.split(" ")]
    for text in TRICKY + [" ".join(rng.choice(parts) for _ in range(40)) for _ in range(200)]:
        assert encoder.ids(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_other_tokenizers_are_encoded_whole():
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    encoder = tokens.Encoder(path, 100)
    assert not encoder.separable
    whole = tokenizers.Tokenizer.from_file(path).encode(" Hello  world", add_special_tokens=False).ids
    assert encoder.ids(b" Hello  world") == np.array(whole, "<u4").tobytes()


def test_counts_and_cache(spark, make_docs, odd_rows, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = make_docs(odd_rows, clash=True)
    found = token_counts.count_tokens(docs, cache, limit=100)
    expected = sorted((r[0] or -1, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in found.collect()) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in found.collect())
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() < len(odd_rows)
    again = token_counts.count_tokens(make_docs([*odd_rows, (99, "new text here")]), cache, limit=100)
    assert again.count() == len(odd_rows) + 1 and spark.read.parquet(cache).count() == stored.count() + 1
    assert token_counts.count_tokens(make_docs([]), cache).count() == 0


def test_counts_where_space_matters(spark, make_docs, tmp_path):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "a b"), (2, " a  b "), (3, "a\nb"), (4, "a\n\n\nb")]
    found = token_counts.count_tokens(make_docs(rows), f"file://{tmp_path}/other", path)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found.collect()) == [(i, len(whole.encode(t, add_special_tokens=False).ids)) for i, t in rows]


def brute_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bins += room == capacity
        if room - n:
            bisect.insort(rooms, room - n)
    return bins, sorted(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    lengths = [rng.randint(1, rng.randint(1, capacity)) for _ in range(rng.randint(0, 300))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = packing.plan_bins(histogram, capacity)
    fill = dict.fromkeys(range(bins), 0)
    spans = {}
    for length, rank, n, first, each, offset in plan.tolist():
        assert n <= histogram[length] - rank
        for k in range(n):
            spans.setdefault(first + k // each, []).append((offset + k % each * length, length))
            fill[first + k // each] += length
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    expected, rooms = brute_best_fit(lengths, capacity)
    assert bins == expected and sum(fill.values()) == sum(lengths)
    assert sorted(capacity - f for f in fill.values() if f < capacity) == rooms


def test_capacity_tree():
    rng = random.Random(2)
    tree, there = packing.CapacityTree(100), set()
    for _ in range(2000):
        c = rng.randint(0, 100)
        if rng.random() < 0.5:
            there.add(c)
            tree.mark(c, True)
        else:
            there.discard(c)
            tree.mark(c, False)
        least = rng.randint(0, 100)
        assert tree.tightest(least) == min((x for x in there if x >= least), default=-1)


def test_pack(spark, make_docs, odd_rows, library):
    rng = random.Random(3)
    rows = odd_rows + [(100 + k, prose(rng, rng.randint(0, 60))) for k in range(150)] + [(500 + k, "the same short text") for k in range(60)]
    found = packing.pack(make_docs(rows, clash=True), capacity=128).toPandas()
    expected = []
    for own, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 128):
            part = np.array(ids[k : k + 128], "<u4")
            expected.append((own or -1, k // 128, k, len(part), zlib.crc32(part.tobytes())))
    got = sorted(zip(found["doc_id"].fillna(-1).astype(int), found["piece"], found["start"], found["length"], found["ids_crc32"], strict=True))
    assert got == sorted(expected)
    for _, group in found.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *np.cumsum(group["length"])[:-1].tolist()] and group["length"].sum() <= 128
    assert found["sequence_id"].nunique() == brute_best_fit([e[3] for e in expected], 128)[0]
    assert packing.pack(make_docs([])).count() == 0


def test_pack_does_not_depend_on_partitions(spark, make_docs):
    rng = random.Random(4)
    docs = make_docs([(k, prose(rng, rng.randint(0, 300))) for k in range(80)])
    a, b = packing.pack(docs.repartition(7), 256), packing.pack(docs.coalesce(1), 256)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert a.where(F.col("length") > 256).count() == 0


def test_frequent_chunks_outlive_rare_ones(monkeypatch):
    """A word of every text is encoded once, however many others fill the memory of chunks."""
    encoder, seen = tokens.Encoder(tokens.tokenizer_path(), 20), []
    encode = encoder._encode_chunks
    monkeypatch.setattr(encoder, "_encode_chunks", lambda chunks: (seen.extend(chunks), encode(chunks)))
    for k in range(200):
        text = f"always w{k} x{k} y{k}"
        assert encoder.ids(text.encode()) == np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(encoder.known) + len(encoder.before) <= 2 * (20 + 4)
    assert seen.count(b"always") == 1


def whole(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def by_runs(encoder, texts):
    return [ids[a:b].tolist() for ids, ends in encoder.runs([None if t is None else t.encode() for t in texts]) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def test_capitals_with_marks_are_not_folded_first(library):
    """A small t composes with a diaeresis, a capital one does not, and the library composes before it lower-cases."""
    encoder, texts = tokens.Encoder(tokens.tokenizer_path(), 50), ["T\u0308e", "J\u030c", "H\u0331 W\u030a", "T\u0344", "E\u0301 A, B."]
    assert [np.frombuffer(encoder.ids(t.encode()), "<u4").tolist() for t in texts] == whole(library, texts)


def test_words_are_encoded_once_whatever_stands_beside_them(monkeypatch, library):
    encoder, seen = tokens.Encoder(tokens.tokenizer_path(), 1000), []
    encode = encoder._encode_chunks
    monkeypatch.setattr(encoder, "_encode_chunks", lambda chunks: (seen.extend(chunks), encode(chunks)))
    texts = ["tataga&&& tataga### (tataga) tataga, Tataga.$$$ tataga-12", "r\u00e9r\u00e9%%% 555-7134 tataga's r\u00e9r\u00e9!"]
    assert [np.frombuffer(encoder.ids(t.encode()), "<u4").tolist() for t in texts] == whole(library, texts)
    assert seen.count(b"tataga") == seen.count("r\u00e9r\u00e9".encode()) == 1 and not any(c[0:1].isalpha() and b"'" not in c and not c.decode().isalpha() for c in seen)


@pytest.mark.parametrize("most", [1, 40, 400, 4_000_000])
def test_runs_match_library(monkeypatch, library, most):
    """Texts of a run, runs of one text, texts cut into stretches, chunks of two generations."""
    monkeypatch.setattr(tokens, "RUN", most)
    rng, encoder = random.Random(most), tokens.Encoder(tokens.tokenizer_path(), 60)
    atoms = [*"abeTZ019.,!'\"-_<>|=$ \n\t\r\x1c\x85\u00a0", "'s", "'LL", "<|", "<|endoftext|>", "\u00e9", "\u00c9", "\u00d7", "\u00f7", "\u0301", "\u0338", "\u0308", "\u0130", "\u212a", "\ufb01", "\u65e5", "\u00b2", "\u201d", "\u00ba", "foo", "Bar", "don't", " ", " "]
    texts = [None, "", " ", *("".join(rng.choice(atoms) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(150))]
    assert by_runs(encoder, texts) == whole(library, texts)
    assert by_runs(encoder, texts[3:90]) == whole(library, texts[3:90])
    assert list(encoder.runs([])) == []
