"""Residue codes on Arrow string columns, as flat numpy arrays.

A column of sequences becomes one array of codes (A, C, G, T/U = 0..3, all
else = 4) in which every row is followed by one code 4, so that no window of
valid codes crosses a row. Nulls count as empty rows. Characters outside ASCII
are one code each, whatever their number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BAD = 4
_CODE = np.full(256, BAD, np.uint8)
for _i, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _x in _letters:
        _CODE[ord(_x)] = _i
LETTERS = np.frombuffer(b"ACGTN", np.uint8)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; one byte a character."""
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if len(raw) and raw.max() >= 0x80:
        lead = (raw & 0xC0) != 0x80
        off = np.concatenate(([0], np.cumsum(lead)))[off]
        raw = raw[lead]
    return raw, off


def encode(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with a stop after each row, and the place of each row's first code."""
    n = len(off) - 1
    starts = off[:-1] + np.arange(n)
    codes = np.full(len(raw) + n, BAD, np.uint8)
    codes[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(off))] = _CODE[raw]
    return codes, starts


def pieces(column: pa.Array, limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, first character of each, codes, starts) of about ``limit`` letters.

    A row above the limit comes as several pieces that share ``overlap`` letters,
    so that each window of ``overlap + 1`` letters lies in exactly one of them.
    """
    raw, off = raw_bytes(column)
    lens, row, n = np.diff(off), 0, len(off) - 1
    while row < n:
        if lens[row] > limit:
            for at in range(0, max(1, int(lens[row]) - overlap), limit):
                a = int(off[row]) + at
                part = raw[a : min(a + limit + overlap, int(off[row + 1]))]
                yield np.array([row]), np.array([at]), *encode(part, np.array([0, len(part)]))
            row += 1
            continue
        to = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        to = max(row + 1, min(to, n))
        long = np.flatnonzero(lens[row:to] > limit)
        to = row + int(long[0]) if len(long) else to
        yield np.arange(row, to), np.zeros(to - row, np.int64), *encode(raw[off[row] : off[to]], off[row : to + 1] - off[row])
        row = to


def valid(codes: np.ndarray, k: int) -> np.ndarray:
    """For each start, whether the ``k`` codes from there hold no stop."""
    if len(codes) < k:
        return np.zeros(0, bool)
    bad = np.concatenate(([0], np.cumsum(codes == BAD, dtype=np.int32)))
    return bad[k:] == bad[:-k]


class Packed:
    """Two-bit words of 1, 2, 4 ... letters from every start, built by doubling."""

    def __init__(self, codes: np.ndarray):
        self.words = {1: (codes & 3).astype(np.uint64)}

    def __getitem__(self, k: int) -> np.ndarray:
        """Words of ``k <= 32`` letters, one for each start that has so many codes behind it."""
        if k not in self.words:
            half = 1 << (k.bit_length() - 1)
            if half == k:
                half //= 2
            a, b = self[half], self[k - half]
            n = max(0, len(self.words[1]) - k + 1)
            self.words[k] = (a[:n] << np.uint64(2 * (k - half))) | b[half : half + n]
        return self.words[k]


def reverse_complement16(words: np.ndarray) -> np.ndarray:
    """Reverse complement of 16-letter words held in uint32."""
    x = ~words
    x = ((x >> np.uint32(2)) & np.uint32(0x33333333)) | ((x & np.uint32(0x33333333)) << np.uint32(2))
    x = ((x >> np.uint32(4)) & np.uint32(0x0F0F0F0F)) | ((x & np.uint32(0x0F0F0F0F)) << np.uint32(4))
    return x.byteswap()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
