"""Token ids by the tokenizers library, word by word, with a bounded cache.

The vocabulary that ``default_path`` names drops white space, and its pieces never cross it. Texts of Latin letters, ASCII digits and
marks are cut into the pieces that the vocabulary's own pattern finds, a batch at a time; other texts into what stands between ASCII blanks.
Arrow finds the distinct ones among a batch's pieces, each of which is encoded once: a Latin piece by the
vocabulary's merges, any other by the whole tokenizer. All this holds for a file with exactly that normalizer and
pattern, which is verified as the file is read; with any other file, whole texts go through the library.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces kept per Python worker and generation; when the young ones are that many, the old ones go.
CACHE = 200_000
#: Characters whose pieces are looked up together.
GROUP_CHARS = 8_000_000
_CODERS: dict[str, WordCoder] = {}

# The normalizer and the pre-tokenizer of the one vocabulary whose words may be encoded one by one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: What cuts a text, by byte: blanks, letters (of which all bytes beyond ASCII are part here), digits, marks.
_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 13, 32]] = _BLANK
_KIND[[*range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
#: The ASCII that may stand in a text that is cut by bytes.
_ASCII = bytes([9, 10, 13, *range(32, 127)])
#: Beyond ASCII: up to here nothing composes, and lower case goes letter by letter but for one.
_LAST_LATIN, _DOTTED = "\u024f", "\u0130"
#: Letters that an apostrophe of its own takes along.
_TAKES = ("s", "t", "re", "ve", "m", "ll", "d")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def splits_words(file: dict) -> bool:
    """Does this tokenizer file encode words one by one, in the way this module knows?"""
    model = file["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    marks = all(t["content"].startswith("<|") and not t["normalized"] for t in file.get("added_tokens") or [])
    return plain and marks and file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == PRE_TOKENIZER and not any(file.get(k) for k in ("post_processor", "truncation", "padding"))


def lowered(text: str) -> bytes | None:
    """The lower-case UTF-8 of a text that can be cut by bytes, or None."""
    raw = text.encode()
    if more := raw.translate(None, _ASCII):
        # What is cut off in the middle of a character is no text; no such bytes come out of whole letters.
        latin = more.decode()
        if not latin.isalpha() or max(latin) > _LAST_LATIN or _DOTTED in latin:
            return None
    if b"<|" in raw:
        return None
    return text.lower().encode() if more else raw.lower()


def cut(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The pieces of lower-case bytes, as ``PATTERN`` finds them, and where each begins."""
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    begins = np.empty(len(kind), bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _DIGIT
    # An apostrophe at the head of its run takes some letters along; what follows them is a piece of its own.
    quotes = np.flatnonzero((data == 39) & begins)
    if len(quotes):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        taken = np.zeros(len(quotes), np.int64)
        for letters in _TAKES:
            fits = one == ord(letters[0]) if len(letters) == 1 else (one == ord(letters[0])) & (two == ord(letters[1]))
            taken[fits & (taken == 0)] = len(letters)
        heads, taken = quotes[taken > 0], taken[taken > 0]
        begins[heads + 1] = False
        after = heads + 1 + taken
        inside = after < len(kind)
        begins[after[inside]] = True
    text = kind != _BLANK
    begins &= text
    starts = np.flatnonzero(begins)
    kept = data if text.all() else data[text]
    offsets = np.append(np.flatnonzero(begins[text]), len(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept)), starts


class WordCoder(dict):
    """Texts to ids as little-endian unsigned 32-bit integers; the mapping holds the ids of pieces seen lately."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.piece = regex.compile(PATTERN).fullmatch
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_words(json.load(f))

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self._ids(part)
        if len(part) <= 40:
            self[part] = ids
        return ids

    def _ids(self, part: str) -> bytes:
        if not part:
            return b""
        if part.isascii():
            if part.isalpha() and part.islower():
                return self._merged(part)
        elif max(part) > _LAST_LATIN or min(part) < " ":
            return self._whole(part)
        if part == part.lower() and _DOTTED not in part and self.piece(part):
            return self._merged("".join(map(self.letters.__getitem__, part.encode())))
        return self._whole(part)

    def _merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merge(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _odd(self, text: str) -> bytes:
        """The ids of a text that can't be cut by bytes."""
        return b"".join(map(self.__getitem__, filter(None, text.replace("\t", " ").replace("\n", " ").split(" "))))

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        low = [lowered(t) for t in texts]
        raw = b"\n".join([x or b"" for x in low])
        ends = np.cumsum([len(x or b"") + 1 for x in low])
        pieces, starts = cut(raw)
        found = pieces.dictionary_encode()
        known = found.dictionary
        whole = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known)
        words = pc.binary_join(whole, "\n")[0].as_py().split("\n") if len(known) else []
        ids = pa.array(list(map(self.__getitem__, words)), pa.binary()).take(found.indices)
        data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else memoryview(b"")
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :] if len(ids) else np.zeros(1, np.int32)
        at = at[np.searchsorted(starts, np.concatenate([[0], ends]))].tolist()
        return [bytes(data[a:b]) if x is not None else self._odd(t) for t, x, a, b in zip(texts, low, at, at[1:], strict=False)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; a null one has none."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if not self.by_word:
                yield self._whole(text)
                continue
            if held and size + len(text) > GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._group(held)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def coder(path: str) -> WordCoder:
    """This worker's coder for a vocabulary file; tasks that follow find its cache filled."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]
