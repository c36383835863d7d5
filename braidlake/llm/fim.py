"""Fill-in-the-middle: a share of documents is cut into prefix, middle and suffix, which are then written out of order.

The tokenizers library's Split pre-tokenizer isolates the matches of a pattern and gives their offsets in code points; the
number of offsets is a text's number of units n, and the offset of a rank is where a slice ends. Nothing is trained. Ranks
and forms come from the hash of a seed and the document's id, so reruns agree however rows lie.

Defined results: a null text is empty; an empty text, or one that holds a marker, stays plain, so every output can be turned
back; a null doc_id is hashed as the empty string; rows that repeat a doc_id are cut at the same ranks, each by its own n; a
very long text is matched in windows that end where a unit does; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.llm._common import slices

#: A unit is a word with the white space before it; white space that ends a text is a unit too.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What marks prefix, suffix and middle in the output.
MARKERS = ("<P>", "<S>", "<M>")
#: Percent of documents that are transformed, and of these percent with the suffix first.
RATE, SPM_RATE, SEED = 50, 80, "42:"
#: Code points that one call of the pre-tokenizer matches, or as many more as the unit there needs.
WINDOW = 1 << 20
#: A unit ends wherever white space follows another character.
_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
_SPLIT = None

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> np.ndarray:
    """Where each unit ends, in code points."""
    global _SPLIT
    if _SPLIT is None:
        from tokenizers import Regex, pre_tokenizers

        _SPLIT = pre_tokenizers.Split(Regex(UNIT), behavior="isolated")
    ends, at = [], 0
    while at < len(text):
        cut = _END.search(text, at + WINDOW) if len(text) - at > WINDOW else None
        until = cut.start() if cut else len(text)
        found = _SPLIT.pre_tokenize_str(text[at:until])
        ends.append(np.fromiter((offset[1] for _, offset in found), np.int64, len(found)) + at)
        at = until
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four 32-bit numbers from the hash of a seed and an id."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rewrite(doc_id: int | None, text: str, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED):
    """(n, form, code points of the prefix, of the middle, output)."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    at = np.concatenate(([0], ends))
    i, j = sorted(int(at[h % (n + 1)]) for h in (h1, h2))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = MARKERS
    if h4 % 100 < spm_rate:
        return n, "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output."""
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches):
        for b in slices(batches):
            rows = [(i, *rewrite(i, t or "", rate, spm_rate, seed)) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: no marker occurs in it, so the first of each kind is the one that was set."""
    p, s, m = MARKERS

    def between(first: str, last: str | None) -> Column:
        rest = F.substr(output, F.instr(output, F.lit(first)) + F.lit(len(first)))
        return F.substring_index(rest, last, 1) if last else rest

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
