"""Sequences and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = "\0ACGTN"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def oriented(seq: Column, rev: Column) -> Column:
    return F.when(rev == 0, seq).otherwise(reverse_complement(seq))


def pack(seq: str) -> bytes:
    """Three bases a byte, least significant first; other letters become N, and 0 ends the last byte."""
    codes = [max(_BASES.find(c), 0) or 5 for c in seq]
    codes += [0] * (-len(codes) % 3)
    return bytes(codes[i] + 6 * codes[i + 1] + 36 * codes[i + 2] for i in range(0, len(codes), 3))


def unpack(data: bytes) -> str:
    return "".join(_BASES[c] for b in data for c in (b % 6, b // 6 % 6, b // 36) if c)


def masked(seq: Column) -> Column:
    """What packing leaves of a sequence: letters other than ACGT are N."""
    return F.regexp_replace(seq, "[^ACGT]", "N")


def human_size(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            break
        size /= 1024
    return f"{size:.3f} {unit}"


def parse_size(s: str) -> int:
    """A number with an optional suffix k, M or G."""
    factor = {"k": 10**3, "K": 10**3, "M": 10**6, "G": 10**9}.get(s[-1:], 1)
    return int(s[:-1] if factor > 1 else s) * factor


def parse_interval(s: str) -> tuple[int, int]:
    a, _, b = s.partition("..")
    start, end = int(a), int(b)
    if start >= end or start < 0:
        raise ValueError(f"bad interval {s}")
    return start, end


def parse_oriented(s: str) -> int:
    """12+ or 12- as a handle."""
    if s[-1:] not in ("+", "-") or not s[:-1].isdigit():
        raise ValueError(f"bad oriented node {s}")
    return 2 * int(s[:-1]) + (s[-1] == "-")


def parse_between(s: str) -> tuple[int, int]:
    """Two oriented nodes with a colon between; a bare number is forward."""
    a, colon, b = s.partition(":")
    if not colon:
        raise ValueError(f"bad pair of nodes {s}")
    start, end = (parse_oriented(x if x[-1:] in ("+", "-") else x + "+") for x in (a, b))
    return start, end
