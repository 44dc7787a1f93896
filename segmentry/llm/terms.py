"""Terms of whole texts as bytes, in pieces, so that a very long text needs no list of all its words."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Bytes that part terms: with digits as letters (search), without (audit). A-Z never meet this: they are lower-cased first.
APART = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
APART_LETTERS = bytes([*range(0x00, 0x61), *range(0x7B, 0x80)])


def spaced(apart: bytes) -> bytes:
    """A table for bytes.translate: A-Z to a-z, and what parts terms to a space."""
    table = bytearray(range(256))
    table[0x41:0x5B] = bytes(range(0x61, 0x7B))
    for b in apart:
        if not 0x41 <= b <= 0x5A:
            table[b] = 0x20
    return bytes(table)


def pieces(raw: bytes | None, table: bytes) -> Iterator[bytes]:
    """A UTF-8 text with terms parted by spaces, cut at spaces into pieces of about PIECE bytes; nothing for null."""
    text, at = (raw or b"").translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end
