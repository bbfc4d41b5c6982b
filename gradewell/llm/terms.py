"""Terms of UTF-8 texts: maximal runs of some ASCII bytes and of everything beyond ASCII, with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut into terms at a time.
PIECE_BYTES = 4_000_000


def term_table(*separators: tuple[int, int]) -> bytes:
    """For ``bytes.translate``: separators (ranges of bytes, ends included) become spaces, A-Z become a-z."""
    apart = {b for low, high in separators for b in range(low, high + 1)}
    return bytes(0x20 if b in apart else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


#: Letters, and letters with digits. Fixed values.
LETTERS = term_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LETTERS_AND_DIGITS = term_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def term_lists(text: bytes | None, table: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of about ``piece`` bytes: a very long text is never a list at once."""
    if not text:
        return
    text = text.translate(table)
    at = 0
    while len(text) - at > piece:
        end = text.find(b" ", at + piece)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split() if at else text.split()
