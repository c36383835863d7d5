"""Text in byte ranges: which lines begin in a range of a plain or gzip file, and gzip text that can be read that way.

A gzip file may hold many members, one after the other. A range owns the members whose headers begin in it; the lines that
it owns are those that begin after its first byte of text, up to and with one that begins where the next range's text does.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

GZIP = b"\x1f\x8b"
BLOCK = 1 << 20
#: Text of one member that is written: its compressed size must fit 16 bits.
MEMBER = 65_280
#: Yielded between the text of a range and what comes after it.
END = None


def _inflated(f, pos: int) -> Iterator[bytes | int]:
    """The text of the member at a place in blocks, and at last the place after it."""
    f.seek(pos)
    member = zlib.decompressobj(31)  # checks the sum and the length at the member's end
    while not member.eof:
        data = member.unconsumed_tail or f.read(BLOCK)
        if not data:
            raise EOFError(f"the gzip member at byte {pos} is cut off")
        if text := member.decompress(data, BLOCK):
            yield text
    yield f.tell() - len(member.unused_data)


def _is_member(f, pos: int) -> bool:
    try:
        for _ in _inflated(f, pos):
            pass
    except (zlib.error, EOFError):
        return False
    return True


def first_member(f, start: int, end: int) -> int | None:
    """The first place in [start, end) at which a member begins.

    Bytes that only look like a header don't decode to the sum and length at a member's end. They can't be text that is
    stored as it is either: no UTF-8 text has the second byte of the mark after the first.
    """
    at = start
    while at < end:
        f.seek(at)
        data = f.read(min(BLOCK, end - at) + 2)
        found = data.find(GZIP + b"\x08")
        while found >= 0 and at + found < end:
            if _is_member(f, at + found):
                return at + found
            found = data.find(GZIP + b"\x08", found + 1)
        at += BLOCK
    return None


def _next_member(f, pos: int) -> int | None:
    """Where the next member begins after one that ended, beyond zeros that fill up; None at the end of the file."""
    while True:
        f.seek(pos)
        data = f.read(BLOCK)
        rest = data.lstrip(b"\0")
        if rest:
            pos += len(data) - len(rest)
            f.seek(pos)
            if f.read(2) != GZIP:
                raise ValueError(f"there is no gzip member at byte {pos}")
            return pos
        if not data:
            return None
        pos += len(data)


def gzip_blocks(f, start: int, end: int) -> Iterator[bytes | None]:
    """The text of the members of a range, END, and the text after it, in blocks."""
    pos = 0 if start == 0 else first_member(f, start, end)
    if pos is None:
        return
    ended = False
    while pos is not None:
        if pos >= end and not ended:
            if not _is_member(f, pos):  # its own range would take it for no member and say nothing
                raise EOFError(f"the gzip member at byte {pos} is broken or cut off")
            ended = True
            yield END
        for x in _inflated(f, pos):
            if isinstance(x, int):
                pos = _next_member(f, x)
            else:
                yield x
    if not ended:
        yield END


def plain_blocks(f, start: int, end: int) -> Iterator[bytes | None]:
    f.seek(start)
    at = start
    while at < end:
        data = f.read(min(BLOCK, end - at))
        if not data:
            break
        at += len(data)
        yield data
    yield END
    while data := f.read(BLOCK):
        yield data


def lines(blocks: Iterator[bytes | None], first: bool) -> Iterator[list[bytes]]:
    """The lines that a range owns, in lists, without their ends. A line may be of any length."""
    pending: list[bytes] = []  # the pieces of a line whose end isn't met yet
    skipping = not first
    ended = False
    for data in blocks:
        if data is END:
            if skipping:
                return
            ended = True
            continue
        cut = data.find(b"\n")
        if cut < 0:
            if not skipping:
                pending.append(data)
            continue
        if ended:
            pending.append(data[:cut])
            yield [b"".join(pending)]
            return
        parts = data.split(b"\n")
        if skipping:
            skipping = False
            parts = parts[1:]
        elif pending:
            parts[0] = b"".join([*pending, parts[0]])
        pending = [parts[-1]] if parts[-1] else []
        if len(parts) > 1:
            yield parts[:-1]
    if pending and not skipping:
        yield [b"".join(pending)]


def member(text: bytes) -> bytes:
    """One gzip member that says its own size, as block-gzip readers want it. An empty one ends a file."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    if len(body) + 26 > 1 << 16:  # what can't be compressed is stored
        deflate = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = deflate.compress(text) + deflate.flush()
    head = GZIP + b"\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))
