"""Whole batches of text as arrays: code points, their classes, and strings cut at given places."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Bytes of text worked on at a time; batches are walked in pieces of about this size.
PIECE = 4_000_000


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    place = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[place[m.start()] : place[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


@lru_cache(1)
def invisible_characters() -> np.ndarray:
    """Whether a code point is a format character or variation selector: without width of its own."""
    import regex

    out = np.zeros(0x110000, bool)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for m in regex.finditer(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]", "".join(map(chr, points))):
        out[points[m.start()]] = True
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def widths(codes: np.ndarray) -> np.ndarray:
    """Bytes that each code point takes in UTF-8."""
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def strings(data: bytes, offsets: np.ndarray) -> pa.Array:
    """The pieces of data between the offsets, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of all i in turn, lengths[i] of each."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of the list whose texts have about `most` characters together; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
