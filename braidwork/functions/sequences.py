"""Column expressions on sequences: codes, complements, weights, quality, costs and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.kernels.params import AMINO, Params


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def residues(seq: str | Column) -> Column:
    """A, C, G, T in capitals, U as T, all else as N."""
    return F.regexp_replace(F.translate(_c(seq), "acgtuU", "ACGTTT"), "[^ACGT]", "N")


def encode(seq: str | Column) -> Column:
    """Letters to digits: A, C, G, T/U to 0..3, all else to 4."""
    return F.translate(residues(seq), "ACGTN", "01234")


def decode(codes: str | Column) -> Column:
    """Digits to letters; 5 is the gap."""
    return F.translate(_c(codes), "012345", "ACGTN-")


def amino_codes(seq: str | Column) -> Column:
    """Letters to an array of codes in the 27-letter alphabet; unknown letters are 26."""
    place = F.create_map(*[F.lit(x) for i, a in enumerate(AMINO[:-1]) for x in (a, i)])
    return F.transform(F.split(F.translate(_c(seq), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ""), lambda x: F.coalesce(F.try_element_at(place, x), F.lit(len(AMINO) - 1)))


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(residues(seq), "ACGT", "TGCA"))


def quality_weights(qual: str | Column) -> Column:
    """Quality character - 32 for each letter; null for null."""
    return F.transform(F.filter(F.split(_c(qual), ""), lambda x: x != ""), lambda x: F.ascii(x) - 32)


def phred(cover: str | Column, n: str | Column) -> Column:
    """Quality code (33 and up) of a base that ``cover`` of ``n`` reads support."""
    x = 13.8 * (1.25 * _c(cover) / _c(n) - 0.25)
    p = 1.0 - 1.0 / (1.0 + F.exp(-x))
    return (33 + (-10.0 * F.log10(p) + 0.499).cast("int")).cast("int")


def ilog2(x: str | Column) -> Column:
    """Whole binary logarithm of an integer; -1 for 0."""
    return F.length(F.regexp_replace(F.bin(_c(x)), "^0+", "")) - 1


def gap_cost(n: str | Column, params: Params) -> Column:
    """What a gap of n letters costs."""
    n = _c(n)
    if not params.pieces:
        return n * params.gap_extend[0]
    costs = [F.lit(oe - e) + n * e for oe, e in params.pieces]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def path_score(weight: str | Column, total: str | Column) -> Column:
    """Rounded log of an edge's part of what leaves its start, at least -20; 0 without weight."""
    w, t = _c(weight), _c(total)
    return F.when((w > 0) & (t > 0), F.greatest(F.round(F.ln(w / t)), F.lit(-20.0))).otherwise(F.lit(0.0)).cast("int")


def hash_word(word: str | Column, bits: int) -> Column:
    """The invertible mix of a word of so many bits that orders minimisers. Sums are masked before they can overflow."""
    mask = F.lit((1 << bits) - 1)
    shl = lambda c, n: F.shiftleft(c, n).bitwiseAND(mask)
    add = lambda *c: c[0] if len(c) == 1 else (add(*c[:-1]) + c[-1]).bitwiseAND(mask)
    x = _c(word).bitwiseAND(mask)
    x = add(mask - x, shl(x, 21))
    x = x.bitwiseXOR(F.shiftright(x, 24))
    x = add(x, shl(x, 3), shl(x, 8))
    x = x.bitwiseXOR(F.shiftright(x, 14))
    x = add(x, shl(x, 2), shl(x, 4))
    x = x.bitwiseXOR(F.shiftright(x, 28))
    return add(x, shl(x, 31))


def word_code(word: str | Column) -> Column:
    """Two bits a letter of a word of A, C, G and T."""
    return F.conv(F.translate(_c(word), "ACGT", "0123"), 4, 10).cast("long")
