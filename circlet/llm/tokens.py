"""Whole-text encoding with a public tokenizer and a bounded cache of text pieces."""

from __future__ import annotations

import os
import re
from array import array

#: Latin letters, digits and fractions up to U+017F: here \p{L} and \p{N} are fixed, so Python's re can cut where the tokenizer cuts.
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_SHORT = "'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]"
#: The byte-level tokenizer knows lower-case contractions only.
_SHORT_LOW = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE = re.compile(rf"{_SHORT_LOW}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD = re.compile(rf"{_SHORT}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Other characters, and separators on which the libraries' \s differ, take the plain way. U+0130 and U+0149 change when lower-cased.
_ODD = re.compile("[^\x00-\x1b -\u012f\u0131-\u0148\u014a-\u017e]")  # one class, which is searched faster than two


#: Byte-level vocabularies write each byte as a letter: visible ones as themselves, the others as those after U+00FF.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}


class _Known(dict):
    """ids of pieces by piece; a new one goes to the vocabulary's own model. At most ``limit`` are kept."""

    def __init__(self, tokenize, lower: bool, limit: int):
        self.tokenize, self.lower, self.limit = tokenize, lower, limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        letters = (piece.lower() if self.lower else piece).encode().decode("latin-1").translate(_LETTER)
        ids = self[piece] = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        return ids


class Encoder:
    """ids of whole texts as little-endian 32-bit bytes.

    Cuts a text where the tokenizer itself always cuts, and keeps the ids of at
    most ``cache`` pieces. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str, words: bool, cache: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.cut = (_WORD if words else _BYTE).findall
        self.known = _Known(self.t.model.tokenize, words, cache)

    def plain(self, text: str) -> bytes:
        return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Null texts are empty and have no ids."""
        get, cut, odd = self.known.__getitem__, self.cut, _ODD.search
        return [b"" if not x else self.plain(x) if odd(x) else b"".join(map(get, cut(x))) for x in texts]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """One per Python worker."""
    if (path, words) not in _encoders:
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]


def groups(texts: list, most: int = 2_000_000):
    """Ranges of rows of at most about ``most`` characters, so that a batch of long texts stays small."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
