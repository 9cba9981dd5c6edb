"""Token ids of whole texts from a tokenizer file, with a bounded memory of chunks already encoded.

For the word-level BPE file the library drops white space and never merges or matches across it, so the ids of a
text are the ids of its chunks between spaces and line feeds, one after the other. `Encoder` checks that the file
is of this kind (the normaliser folds white space, the split pattern excludes it) and encodes whole texts where not.
If the split pattern is known, chunks are also cut where it always cuts: between letters, digits and punctuation.

Texts are encoded some hundred at a time: their chunks are told apart in Arrow, each distinct one is looked up once,
and numpy puts the ids in their places, so that Python handles distinct chunks only.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa

from .common import hold_only

_ENCODERS: dict[tuple[str, int], "Encoder"] = {}
#: Line feeds to spaces; and the same with A-Z in lower case, for tokenizers that lower-case anyway.
_BREAK = bytes.maketrans(b"\n", b" ")
_FOLD = bytes.maketrans(b"\nABCDEFGHIJKLMNOPQRSTUVWXYZ", b" abcdefghijklmnopqrstuvwxyz")
#: About so many bytes of texts are encoded at a time.
RUN = 4_000_000
#: A pattern that matches runs of letters, single digits and runs of other marks, and contractions before those.
_CLASSED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes: 1 letters, 2 digits, 3 punctuation, 0 all that may depend on what stands beside it (apostrophes,
#: which begin contractions, and what is not ASCII).
_CLASS = bytes(1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if chr(b).isprintable() and b not in b" '" else 0 for b in range(128)) + bytes(128)
#: Words that no step before the model changes: small letters of ASCII and Latin-1.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: a digest of its file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _separable(spec: dict) -> bool:
    """True if no token, added token or pre-token of this file can hold or span a space or line feed."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    split = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "[^\\s" in steps[0]["pattern"].get("Regex", "")
    bytelevel = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") for s in steps[1:])
    norm = spec.get("normalizer") or {}
    kinds = {n.get("type") for n in norm.get("normalizers", [norm])}
    return bool(split and bytelevel and kinds <= {"NFC", "Replace", "Lowercase", None} and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])))


def drops_space(path: str) -> bool:
    """True if the ids of a text are those of its chunks between spaces and line feeds."""
    with open(path, encoding="utf-8") as f:
        return _separable(json.load(f))


def _cut_classes(data: bytes) -> np.ndarray:
    """Where a space may be put into text that ends in one: a letter of ASCII or Latin-1, a digit or punctuation on either
    side, not both letters or both punctuation. `_CLASSED` ends a match at each of these places, and nothing composes
    across them."""
    raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(_CLASS)), np.uint8)
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # these two are signs
    kind[lead] = kind[lead + 1] = 1
    left, right = kind[:-1], kind[1:]
    return np.flatnonzero(((left != right) | (left == 2)) & (left != 0) & (right != 0)) + 1


def _stretches(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about `most` bytes, without the space or line feed between two of them."""
    at = 0
    while len(text) - at > most:
        found = re.compile(rb"[ \n]").search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class Encoder:
    """ids(text): the ids of a text as little-endian unsigned 32-bit bytes, as the library gives them. runs(texts): those
    of many texts, as arrays."""

    def __init__(self, path: str, most: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.separable = _separable(spec)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        kinds = {n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        self.folds = "Lowercase" in kinds
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = spec["model"]["vocab"] if isinstance(spec["model"].get("vocab"), dict) else {}
        #: ends[i]: token i ends a pre-token
        self.ends = np.zeros(max(vocab.values(), default=0) + 2 + len(self.special), bool)
        for token, i in vocab.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        #: the split pattern is known: chunks are cut by classes; `small` encodes words that only the model changes
        self.classed = self.separable and (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]])[0]["pattern"].get("Regex") == _CLASSED
        self.small = None
        norms = (spec.get("normalizer") or {}).get("normalizers", [])
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if self.classed and self.ends.any() and all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": "\\s+"} for n in norms) and [(s["type"], s.get("use_regex")) for s in steps[1:]] == [("ByteLevel", False)]:
            self.small = Tokenizer(self.library.model)  # the model is shared, not copied
            self.small.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: chunks encoded since the last change of generations, at most about `most`, and those of the one before: what
        #: is seen again is kept, what was seen once is dropped after two
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str, most: int = 250_000) -> "Encoder":
        """One encoder for each file in a worker process."""
        hold_only("tokens", _ENCODERS.clear)
        if (path, most) not in _ENCODERS:
            _ENCODERS[path, most] = Encoder(path, most)
        return _ENCODERS[path, most]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, library, words: list[bytes]) -> bool:
        """Adds words of letters alone to what is known: encoded in one go, told apart by the tokens that end a word."""
        ids = np.array(library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return False
        raw, at = ids.tobytes(), 0
        for word, to in zip(words, (4 * cuts).tolist(), strict=True):
            self.known[word] = raw[at:to]
            at = to
        return True

    def _encode_chunks(self, chunks: list[bytes]) -> None:
        """Adds chunks to what is known: words together if their ends can be told, all other chunks one by one."""
        small, letters, rest = [], [], []
        if self.small is not None:
            small, chunks = list(filter(_SMALL, chunks)), list(filterfalse(_SMALL, chunks))
        for c in chunks:
            text = c.decode()
            # some letters turn into a letter and a mark
            (letters if (text if c.isascii() else text.lower()).isalpha() else rest).append(c)
        if small and not self._encode_words(self.small, small):
            letters += small
        if letters and not self._encode_words(self.library, letters):
            rest += letters
        if rest:
            self.known.update(zip(rest, self._encode([c.decode() for c in rest]), strict=True))

    def _look_up(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct chunks."""
        before, found = self.before, list(map(self.known.get, chunks))
        missing = [c for c, own in zip(chunks, found, strict=True) if own is None]
        if not missing:
            return found
        if len(self.known) > self.most:
            self.before, self.known = self.known, {c: own for c, own in zip(chunks, found, strict=True) if own is not None}
        known, new = self.known, []
        for c in missing:
            own = before.get(c)
            if own is None:
                new.append(c)
            else:
                known[c] = own
        if new:
            self._encode_chunks(new)
        return [known[c] if own is None else own for c, own in zip(chunks, found, strict=True)]

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # special tokens are matched as they stand, so texts that may hold one are neither folded nor cut by classes;
        # small letters compose with marks (U+0300 to U+037F) with which capitals do not, so texts with such are not folded
        special = np.array([any(t[:2] in x for t in self.special) for x in texts])
        joined = b" ".join([x.translate(_FOLD if self.folds and not s and b"\xcc" not in x and b"\xcd" not in x else _BREAK) for x, s in zip(texts, special, strict=True)]) + b" "
        ends = np.cumsum([len(x) + 1 for x in texts])  # after the space that follows each text
        data = np.frombuffer(joined, np.uint8)
        if self.classed:
            at = _cut_classes(joined)
            if special.any():
                at = at[~special[np.searchsorted(ends, at, side="right")]]
            data, ends = np.insert(data, at, 32), ends + np.searchsorted(at, ends)
        gaps = np.flatnonzero(data == 32)
        bounds = np.append(0, gaps + 1)
        coded = pa.Array.from_buffers(pa.large_binary(), len(gaps), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        _, starts, values = coded.dictionary.buffers()
        distinct = values[: int(np.frombuffer(starts, np.int64)[len(coded.dictionary)])].to_pybytes()
        own = self._look_up(distinct[:-1].split(b" "))  # each with the space after it, one after the other
        place, ids = coded.indices.to_numpy(), np.frombuffer(b"".join(own), "<u4")
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        each, first = size[place], (np.cumsum(size) - size)[place]
        upto = np.cumsum(each)
        total, last = int(upto[-1]), upto[np.searchsorted(gaps, ends) - 1]
        # the n-th id of a chunk is the n-th of its distinct one
        width = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        at = np.repeat((first - upto + each).astype(width), each)
        at += np.arange(total, dtype=width)
        return ids[at], last

    def _run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.separable and len(texts) > 1:
            return self._ids(texts)
        if self.separable:
            parts = [self._ids([x])[0] for x in _stretches(texts[0], RUN)]
        else:
            parts = [np.frombuffer(x, "<u4") for x in self._encode([x.decode() for x in texts])]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])[-len(texts) :]

    def runs(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts of about RUN bytes: their ids, one text after the other, and where each text's ids end."""
        run, total = [], 0
        for text in texts:
            if run and total + len(text or b"") > RUN:
                yield self._run(run)
                run, total = [], 0
            run.append(text or b"")
            total += len(text or b"")
        if run:
            yield self._run(run)

    def ids(self, text: bytes | None) -> bytes:
        return self._run([text or b""])[0].tobytes()
