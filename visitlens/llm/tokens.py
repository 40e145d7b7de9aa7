"""Hashing the runs of characters of whole Arrow string columns, without a loop over rows.

A column is handled in slices of rows of about ``SLICE`` bytes. Bytes are classed by a table of 256
entries; a token is a longest run of one class other than 0 within one row. As white space is ASCII and
UTF-8 never uses ASCII bytes inside a character, this equals splitting the text. A token's hash is its
polynomial value modulo 2^64, taken from running sums, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

#: Bytes of ASCII white space, as in the word pattern of the contracts.
SPACES = (32, 9, 10, 11, 12, 13)


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + (SLICE >> 2)), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 8 * SLICE:  # a table for a longer text isn't kept
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_classes() -> np.ndarray:
    """Class 1 for all bytes but ASCII white space."""
    table = np.ones(256, np.uint8)
    table[list(SPACES)] = 0
    return table


def run_classes() -> np.ndarray:
    """Class 1 for letters, digits and non-ASCII bytes, 2 for other printable bytes, 0 for white space."""
    table = np.full(256, 2, np.uint8)
    table[128:] = 1
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = 1
    table[list(SPACES)] = 0
    return table


def slices(texts: pa.Array, classes: np.ndarray, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, tokens up to each row) for slices of ``texts``; nulls count as empty.

    The third array has one entry more than the slice has rows. ``lower`` folds A-Z first.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        stop = min(stop, len(texts))
        at = offsets[row : stop + 1]
        part = data[at[0] : at[-1]]
        yield row, *_tokens(part, at - at[0], classes, lower)
        row = stop


def _tokens(part: np.ndarray, at: np.ndarray, classes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(part)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if lower:
        part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
    kind = classes[part]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge[at] = True
    bounds = np.flatnonzero(edge)
    held = kind[bounds[:-1]] > 0
    start, end = bounds[:-1][held], bounds[1:][held]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * _power_table(_BASE_INVERSE, n)[start])
    return hashes, np.searchsorted(start, at).astype(np.int64)
