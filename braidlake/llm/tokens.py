"""Byte-level BPE through the tokenizers library, with a bounded per-worker memory of chunks already encoded.

A chunk starts at a single space (or at the text's start) that follows a character other than white space. The
pre-tokenizer's pattern never joins such a character with the white space after it, so a text's ids are its chunks' ids
in a row. Texts with longer runs of white space before a space are encoded by a pattern that cuts at the same places.
Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import re
import sys
from array import array

MEMORY = 500_000
_WIDE = re.compile(r"[^\S\x1c-\x1f] ")
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memory(dict):
    """chunk -> its ids as little-endian 32-bit bytes; two generations of at most MEMORY chunks each."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix, self.old = encode, prefix, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(self.prefix + chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.direct = self.tokenizer.normalizer is None and "ByteLevel" in str(self.pre)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.bare, self.spaced = _Memory(self._encode, ""), _Memory(self._encode, " ")

    def _encode(self, chunk: str) -> bytes:
        if self.direct:
            body, tokenize = chunk[1:] if chunk[:1] == " " else chunk, self.model.tokenize
            memory = self.bare if len(body) == len(chunk) else self.spaced
            if body.isalpha():
                mark = "" if memory is self.bare else "\u0120"
                piece = mark + (body if body.isascii() else body.encode().decode("latin-1").translate(_BYTE_CHARS))
                return _bytes([t.id for t in tokenize(piece)])
            if "\n" in body:
                head, _, tail = body.partition("\n")
                if head and tail and not head[-1].isspace() and not tail[0].isspace():
                    return memory[head] + self.bare["\n"] + self.bare[tail]
            elif body[-1:] in (",", ".") and body[:-1].isalpha():
                return memory[body[:-1]] + self.bare[body[-1]]
            ids = [t.id for piece, _ in self.pre.pre_tokenize_str(chunk) for t in tokenize(piece)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return _bytes(ids)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, little-endian 32-bit. Null is taken as empty."""
        if not text:
            return b""
        if not self.direct:
            return self._encode(text)
        if _WIDE.search(text):
            return b"".join(map(self.bare.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
