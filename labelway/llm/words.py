"""ASCII-lower-cased words of a text as UTF-8 bytes, in blocks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TERMS = bytearray(_LOWER)
for _code in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
    _TERMS[_code] = 0x20


def _blocks(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(text):
        end = start + BLOCK
        if end < len(text):
            cut = _BLANK.search(text, end) if table is _LOWER else _CUT.search(text, end)
            end = cut.start() if cut else len(text)
        words = text[start:end].translate(table).split()
        if words:
            yield words
        start = end


_CUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Runs of other than ASCII blanks."""
    return _blocks(text, _LOWER)


def term_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Runs of ASCII letters, digits and anything beyond ASCII."""
    return _blocks(text, bytes(_TERMS))
