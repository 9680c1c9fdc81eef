"""Settings of alignment and consensus, validated once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np

NUCLEOTIDES, AMINO = "ACGTN", "ACGTNBDEFHIJKLMOPQRSUVWXYZ*"  # fixed orders of the codes; the gap follows the last


class Mode(str, Enum):
    GLOBAL, LOCAL, EXTEND = "global", "local", "extend"


class Gap(str, Enum):
    LINEAR, AFFINE, CONVEX = "linear", "affine", "convex"


class Consensus(str, Enum):
    HEAVIEST, FREQUENT = "heaviest", "frequent"


@dataclass(frozen=True)
class Params:
    match: int = 2
    mismatch: int = 4
    gap_open: tuple[int, int] = (4, 24)
    gap_extend: tuple[int, int] = (2, 1)
    mode: Mode = Mode.GLOBAL
    amino: bool = False
    band: int = 10  # below 0: no band
    band_part: float = 0.01
    zdrop: int = -1
    k: int = 19
    w: int = 10
    min_window: int = 500
    seeding: bool = False
    progressive: bool = False
    both_strands: bool = False
    longest_first: bool = False
    use_quality: bool = False
    path_score: bool = False
    gap_on_right: bool = False
    gap_at_end: bool = False
    spanning_only: bool = False  # gaps of most-frequent consensus count spanning reads
    consensus: Consensus = Consensus.HEAVIEST
    max_consensus: int = 1
    min_freq: float = 0.25
    matrix: np.ndarray | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.match < 0 or self.mismatch < 0 or min(self.gap_open) < 0 or min(self.gap_extend) < 0:
            raise ValueError("scores and penalties must not be negative")
        if self.gap_extend[0] == 0 and self.gap_extend[1] == 0:
            raise ValueError("one of the gap extensions must be above 0")
        if not 1 <= self.max_consensus <= 10:
            raise ValueError("max_consensus must be from 1 to 10")
        if not 0 < self.w < 256 or not 0 < self.k <= (11 if self.amino else 28):
            if self.amino and self.k > 11:  # the defaults for nucleotides are too long
                object.__setattr__(self, "k", 7)
                object.__setattr__(self, "w", 4)
            else:
                raise ValueError("w must be from 1 to 255, k from 1 to 28")
        for name, kind in (("mode", Mode), ("consensus", Consensus)):
            object.__setattr__(self, name, kind(getattr(self, name)))
        if self.mode is Mode.LOCAL:
            object.__setattr__(self, "band", -1)

    @property
    def letters(self) -> str:
        return AMINO if self.amino else NUCLEOTIDES

    @property
    def m(self) -> int:
        return len(self.letters)

    @property
    def gap(self) -> Gap:
        if self.gap_open[0] == 0:
            return Gap.LINEAR
        return Gap.AFFINE if self.gap_open[1] == 0 else Gap.CONVEX

    @property
    def pieces(self) -> list[tuple[int, int]]:
        """(open + extend, extend) of each piece of the gap cost; a linear cost has none."""
        n = {Gap.LINEAR: 0, Gap.AFFINE: 1, Gap.CONVEX: 2}[self.gap]
        return [(o + e, e) for o, e in list(zip(self.gap_open, self.gap_extend))[:n]]

    def gap_cost(self, n: int) -> int:
        """What a gap of n letters costs."""
        if self.gap is Gap.LINEAR:
            return n * self.gap_extend[0]
        return min(oe - e + n * e for oe, e in self.pieces)

    def scores(self) -> np.ndarray:
        """Score of a node's letter (row) against a read's (column)."""
        if self.matrix is not None:
            return np.asarray(self.matrix, np.int32)
        s = np.full((self.m, self.m), -self.mismatch, np.int32)
        np.fill_diagonal(s, self.match)
        s[-1, :] = s[:, -1] = 0
        return s

    def encode(self, seq: str) -> np.ndarray:
        table = np.full(256, self.m - 1, np.uint8)
        for i, c in enumerate(self.letters):
            table[ord(c)] = table[ord(c.lower())] = i
        if not self.amino:
            table[ord("U")] = table[ord("u")] = 3
        return table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]

    def decode(self, codes) -> str:
        letters = self.letters + "-"
        return "".join(letters[c] for c in codes)

    def with_(self, **changes) -> Params:
        return replace(self, **changes)
