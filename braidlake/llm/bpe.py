"""Byte-level BPE by tiktoken and a local file of ranks: texts to ids, and ids back to raw bytes.

Long texts are cut where no match of the pattern can reach across: before white space that follows another character, and
between a letter and a digit or punctuation. White space of great length, on which the pattern's lookahead would run out of
stack, is one match up to its last character; that match is merged by itself.

Defined results: a null text is empty and has no ids; strings that look like special tokens are ordinary text; rows that
repeat are encoded each; very long texts are encoded whole, window by window; an empty table gives none; other columns are
ignored, whatever their names. Null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidlake.llm._common import slices

#: Code points that one call encodes, or as many more as the next safe cut needs.
WINDOW = 1 << 16
#: White space of so many characters is taken out of the pattern's hands.
WIDE = 1 << 12
#: White space as the library's patterns know it: the characters of that Unicode property.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER, _OTHER = "A-Za-z\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3", "0-9!-/:-@\\[-`{-~\\u3001\\u3002\\uff0c"
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_OTHER}])")
_RUN = re.compile(f"[{_SPACE}]{{{WIDE},}}")
_CODECS: dict[tuple[str, str], Codec] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text."""
        out, at, text = array("I"), 0, text or ""
        while at < len(text):
            cut = _CUT.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            until = cut.start() if cut else len(text)
            run = _RUN.search(text, at, until)
            if run is None:
                out.extend(self.encoding.encode_ordinary(text[at:until]))
                at = until
                continue
            out.extend(self.encoding.encode_ordinary(text[at : run.start()]))
            at = run.end() - (run.end() < len(text))  # the last one may begin the next match
            out.extend(self.encoding._encode_single_piece(text[run.start() : at]))
        return np.frombuffer(out, np.uint32).astype(np.int32) if out else np.zeros(0, np.int32)

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)


def codec(ranks: str, pattern: str) -> Codec:
    """One for each Python worker."""
    if (ranks, pattern) not in _CODECS:
        _CODECS[ranks, pattern] = Codec(ranks, pattern)
    return _CODECS[ranks, pattern]


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row a document: doc_id, ids."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def texts_to_ids(batches):
        c = codec(ranks, pattern)
        for b in slices(batches):
            found = [c.encode(text) for text in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(texts_to_ids, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the raw bytes that (doc_id, ids) stand for; they need not be UTF-8 where ids were cut."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def ids_to_bytes(batches):
        c = codec(ranks, pattern)
        for b in slices(batches):
            data = [c.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(ids_to_bytes, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, data binary")
