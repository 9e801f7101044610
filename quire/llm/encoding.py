"""Exact, memoised text encoding with the tokenizers library.

A text in Latin-1 characters is cut into the vocabulary's own pre-tokens by one pattern; each pre-token's
ids come from the library's BPE model and are kept, for pre-tokens recur. Any other text takes the
library's whole path. Both ways give the library's ids (tests compare them).
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Unicode classes L, N and White_Space within Latin-1, and the pre-token patterns of the two vocabularies in them.
_L, _N, _W = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_BYTE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_W}{_L}{_N}]+")


_SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class _Memo(dict):
    """Pre-token to its ids as native unsigned 32-bit integers; filled by the BPE model on first use."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        self[piece] = got = self.ids(piece.encode("utf-8").decode("latin-1").translate(self.letters))
        return got

    def ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()


class _Apart(Exception):
    """A text whose white space doesn't let it be cut at spaces."""


class _Chunks(dict):
    """What stands between single spaces to its ids. A chunk counts with the space before it where the vocabulary keeps spaces."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.pieces, self.folds, self.memo = encoder.pieces, encoder.folds, encoder.memo
        self.space = encoder.memo.letters[32]

    def __missing__(self, chunk: str) -> bytes:
        if self.folds:
            got = self.pieces(chunk)
        elif chunk.isalpha() and (chunk.isascii() or max(chunk) <= "ÿ"):  # one pre-token, which needn't be kept twice
            got = self.memo.ids(self.space + chunk.encode("utf-8").decode("latin-1").translate(self.memo.letters))
        elif chunk[-1:] in _SIGNS and chunk[:-1].isalpha() and (chunk.isascii() or max(chunk) <= "ÿ"):
            got = self[chunk[:-1]] + self.memo[chunk[-1]]
        elif not chunk or chunk[0].isspace():
            raise _Apart
        else:
            got = self.pieces(" " + chunk)
        self[chunk] = got
        return got


class Encoder:
    """encode_bytes(text): the library's ids. most: entries of its two memos on average, after which both start anew.

    A pre-token never reaches past white space into what precedes it, so a space between two other
    characters always begins one, and a text's ids are those of its chunks between spaces.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.most, self.folds = most, self.library.normalizer is not None
        self.model = self.library.model
        self.model._resize_cache(0)  # the memos take its place
        self.memo, self.pattern = _Memo(self.model), _WORD_PATTERN if self.folds else _BYTE_PATTERN
        self.chunks = _Chunks(self)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def pieces(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text.lower() if self.folds else text)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as native unsigned 32-bit integers, in a byte string."""
        if len(self.memo) + len(self.chunks) > 2 * self.most:
            self.memo.clear()
            self.chunks.clear()
        first, *rest = text.split(" ")
        if rest and not first and not self.folds:
            return self.pieces(text)
        try:
            return self.pieces(first) + b"".join(map(self.chunks.__getitem__, rest))
        except _Apart:
            return self.pieces(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most: int = 600_000) -> Encoder:
    """One encoder for each vocabulary file in a Python worker; its memo outlives a task, and so stays beside what later stages hold. The last caller's most holds."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
    _encoders[path].most = most
    return _encoders[path]
