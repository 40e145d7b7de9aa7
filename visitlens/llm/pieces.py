"""Words of UTF-8 texts by byte translation and ``bytes.split``, a bounded piece of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20


def translation(word_characters: str) -> bytes:
    """A table of 256 bytes: A-Z become a-z, every other ASCII character but ``word_characters`` becomes a space.

    Bytes above 127 stay: UTF-8 uses them only inside characters that are no separators.
    """
    table = bytearray(range(256))
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b) in word_characters else 32
    return bytes(table)


def pieces(text: bytes, table: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Lists of the words of ``text`` in order; no word is cut, however long."""
    at = 0
    while at < len(text):
        part = text[at : at + size].translate(table)
        at += len(part)
        if part[-1] != 32:  # go on to the end of the word
            rest = [part]
            while at < len(text):
                more = text[at : at + size].translate(table)
                end = more.find(b" ")
                rest.append(more if end < 0 else more[:end])
                at += len(rest[-1])
                if end >= 0:
                    break
            part = b"".join(rest)
        yield part.split()
