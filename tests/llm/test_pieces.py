import random
import struct

import pytest

from gridloom.llm import sentencepiece_codec as codec
from gridloom.llm.tokens import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return codec.Model(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


TEXTS = ["", "  a  b   ", "\n\nfoo   bar\t", "日本語😀 ñandú", "a" * 200, "hello.  world", "The quick, brown fox (12345)...", "ﬁ é é", "\x00\x01", "x" * 300 + " " + "ab" * 200, "internationalization" * 50]


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_same_ids_as_library(model, library):
    rng = random.Random(0)
    letters = "abcdeionrst ,.éß\n01日ヴ"
    for text in TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(400)]:
        assert ids(model.encode(text)) == library.encode(text), text
        assert model.decode(model.encode(text)) == text == library.decode(library.encode(text)) or "▁" in text


def test_stream_commits_early_and_agrees(model, library):
    text = model.normalise("unbelievablyinternationalizedconstructions" * 200)
    runs = list(model.search(text))
    assert len(runs) > 100 and max(sum(map(len, r)) for r in runs) <= 4 * model.longest
    assert [i for r in runs for p in r for i in model._ids_of(p)] == library.encode("unbelievablyinternationalizedconstructions" * 200)


def test_unigram_search_is_viterbi(model):
    """The same search with sums of scores, against a search over all splits."""
    rng = random.Random(1)
    toy = codec.Model(tokenizer_path("piece_bpe_32k.model"))
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa"]
    toy.bpe, toy.vocab, toy.score = False, {p: i for i, p in enumerate(pieces)}, [-rng.uniform(1, 9) for _ in pieces]
    toy.longest, toy.least = 3, -30.0
    toy.tails = {p[k:] for p in pieces for k in range(len(p))}

    def best(text):
        found = [(0.0, [])]
        for i in range(1, len(text) + 1):
            found.append(max(((found[j][0] + toy.score[toy.vocab[text[j:i]]], [*found[j][1], text[j:i]]) for j in range(max(0, i - 3), i) if text[j:i] in toy.vocab), key=lambda t: t[0]))
        return found[-1][1]

    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        assert [p for r in toy.search(text) for p in r] == best(text)


def test_unknown_characters_without_byte_pieces():
    """A run of unknown characters is one id, in a stretch and across cuts; known neighbours end it."""
    toy = codec.Model(tokenizer_path("piece_bpe_32k.model"))
    toy.bytes_of, toy.known = {}, {}
    unknown = toy.unknown
    assert ids(toy.encode("a\ue000\ue001\ue002a\ue000"))[-3:] == [unknown, toy.vocab["a"], unknown]
    found = ids(toy.encode("\ue000\ue001 \ue002\ue003a"))
    assert found.count(unknown) == 2 and all(x != unknown or y != unknown for x, y in zip(found, found[1:]))


def test_tables(spark, make_docs, odd_rows, library):
    found = codec.digest_ids(make_docs(odd_rows, clash=True))
    got = sorted((r["doc_id"] or -1, r["n_ids"], r["round_trip"]) for r in found.collect())
    assert got == sorted((r[0] or -1, len(library.encode(r[1] or "")), True) for r in odd_rows)
    docs = make_docs([r for r in odd_rows if r[1] is not None])
    back = codec.decode(codec.encode(docs), into="again")
    assert back.where("text != again").count() == 0 and back.count() == docs.count()
    assert codec.digest_ids(make_docs([])).count() == 0


def test_columns_of_any_name(spark, make_docs):
    """Dots in names, and inner names, do no harm."""
    from pyspark.sql import functions as F

    from gridloom.llm import language, sentencepiece_codec

    docs = make_docs([(1, "the house"), (2, None), (2, None)]).withColumns({"a.b": F.lit(3), "score": F.lit("own"), "c0": F.lit(1)})
    ids = sentencepiece_codec.encode(docs)
    back = sentencepiece_codec.decode(ids, into="again")
    assert back.columns == [*docs.columns, "ids", "again"] and [r["again"] for r in back.orderBy("doc_id").collect()] == ["the house", "", ""]
    found = language.classify(docs, [("en", [" the house "])], into=("guess", "sure"))
    assert found.columns == [*docs.columns, "guess", "sure"] and {(r["a.b"], r["score"]) for r in found.collect()} == {(3, "own")}
