"""Occurrences and records of every term of k letters, counted in burst tries.

Each task keeps one trie: leaves are sorted arrays (term, occurrences,
records) under a prefix, and a leaf that grows beyond ``burst`` terms splits by
its next letter. A task's leaves are written as packed rows. The routing table
is the set of prefixes at which some task's trie burst, cut at ROUTE_DEPTH
letters, so it holds at most 4**ROUTE_DEPTH entries however large the corpus;
each leaf is split along it, and matching subtrees of all tasks are merged. A
trie of more than HELD terms is written and a new one begun; a prefix that holds
more than MERGED terms is routed by further letters. So memory is bounded
whatever the number of distinct terms.

Tasks hand over at most one entry a distinct term, so a term that makes up a
third of all letters costs no more than any other.

Defined results: null and empty sequences hold no term; a null sequence is no
record, an empty one is; an empty table gives an empty result; repeated rows
are records of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.residues import LETTERS, Packed, pieces, valid
from braidwork.plans.columns import take
from braidwork.plans.lineage import written

ROUTE_DEPTH = 7
HELD = 4_000_000  # terms in a task's trie, above which it is written and a new one begun
MERGED = 2_000_000  # terms merged in one group, about
_PIECE = 2_000_000


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    term, occ, rec = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(term, kind="stable")
    term = term[order]
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    return term[first], np.add.reduceat(occ[order], first), np.add.reduceat(rec[order], first)


class BurstTrie:
    """Counters of terms of ``k`` letters (two bits each); leaves cover the term space in order."""

    def __init__(self, k: int, burst: int):
        self.k, self.burst = k, burst
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.leaves = {(0, 0): empty}  # (depth, prefix)

    def _low(self, leaf: tuple[int, int]) -> int:
        return leaf[1] << 2 * (self.k - leaf[0])

    def add(self, term: np.ndarray, occ: np.ndarray, rec: np.ndarray) -> None:
        """Sorted distinct terms with their counters."""
        leaves = sorted(self.leaves, key=self._low)
        cuts = np.append(np.searchsorted(term, np.array([self._low(x) for x in leaves], np.uint64)), len(term))
        for leaf, a, b in zip(leaves, cuts[:-1], cuts[1:]):
            if a < b:
                new = term[a:b], occ[a:b], rec[a:b]
                self._settle(leaf, _merge([self.leaves[leaf], new]) if len(self.leaves[leaf][0]) else new)

    def _settle(self, leaf: tuple[int, int], held: tuple) -> None:
        depth, prefix = leaf
        if len(held[0]) <= self.burst or depth == self.k:
            self.leaves[leaf] = held
            return
        self.leaves.pop(leaf, None)
        cuts = np.searchsorted(held[0], np.array([self._low((depth + 1, prefix * 4 + i)) for i in range(4)], np.uint64))
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(held[0])])):
            self._settle((depth + 1, prefix * 4 + i), tuple(x[a:b] for x in held))


def _small(x: np.ndarray) -> bytes:
    """Values at or above 0 in the narrowest type that holds them, compressed."""
    top = int(x.max(initial=0))
    t = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    return bytes([np.dtype(t).itemsize]) + pa.compress(x.astype(t).tobytes(), codec="zstd", asbytes=True)


def _large(x: bytes, n: int) -> np.ndarray:
    width = x[0]
    return np.frombuffer(pa.decompress(x[1:], n * width, codec="zstd", asbytes=True), f"<u{width}")


_LEAF = "prefix string, n long, term binary, occ binary, rec binary, rows long"


def _pack(prefix: str, held: tuple, rows: int) -> dict:
    term, occ, rec = held
    return {"prefix": prefix, "n": len(term), "term": _small(np.diff(term, prepend=np.uint64(0))), "occ": _small(occ - rec), "rec": _small(rec), "rows": rows}


def _unpack(x: dict) -> tuple:
    n = x["n"]
    rec = _large(x["rec"], n).astype(np.int64)
    return np.cumsum(_large(x["term"], n).astype(np.uint64), dtype=np.uint64), _large(x["occ"], n).astype(np.int64) + rec, rec


def _spell(code: int, depth: int) -> str:
    return "".join("ACGT"[code >> 2 * i & 3] for i in reversed(range(depth)))


def _code(prefix: str) -> int:
    return sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(prefix)))


def _rows(x: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(x, schema=pa.schema([("prefix", pa.string()), ("n", pa.int64()), ("term", pa.binary()), ("occ", pa.binary()), ("rec", pa.binary()), ("rows", pa.int64())]))


def _grow(k: int, burst: int):
    def count(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Packed(codes)[k]
        at = np.flatnonzero(valid(codes, k))
        term = words[at]
        row = np.searchsorted(starts, at, side="right").astype(np.uint64)
        if 2 * k <= 40:  # term and row in one word
            both = (term << np.uint64(24)) | row
            both.sort()
            term, new = both >> np.uint64(24), np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]
        else:
            order = np.lexsort((row, term))
            term, row = term[order], row[order]
            new = np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))[: len(term)]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))[: len(term)])
        if not len(first):
            return term[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
        return term[first], np.diff(np.append(first, len(term))), np.add.reduceat(new.astype(np.int64), first)

    def batches(it):
        trie, rows = BurstTrie(k, burst), 0
        for batch in it:
            column = batch.column(0)
            rows += len(column) - column.null_count
            held = None  # terms so far of a row that comes in several pieces
            for row, first, codes, starts in pieces(column, _PIECE, k - 1):
                term, occ, rec = count(codes, starts)
                if len(row) == 1 and first[0] > 0:
                    rec = (~np.isin(term, held)).astype(np.int64)
                    held = np.union1d(held, term)
                else:
                    held = term
                trie.add(term, occ, rec)
                if sum(len(x[0]) for x in trie.leaves.values()) > HELD:
                    yield _rows([_pack(_spell(p, d), x, 0) for (d, p), x in sorted(trie.leaves.items()) if len(x[0])])
                    trie = BurstTrie(k, burst)
        out = [_pack(_spell(p, d), held, 0) for (d, p), held in sorted(trie.leaves.items()) if len(held[0])]
        yield _rows([*out, _pack("", (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), rows)])

    return batches


def _route(k: int, inner: frozenset[str], more: dict[str, int]):
    """Splits leaves along the prefixes at which some trie burst, and by so many more letters where these hold much."""

    def split(prefix: str, held: tuple, out: list, left: int = -1) -> None:
        if left < 0:
            prefix = prefix[:ROUTE_DEPTH]
            left = more.get(prefix, 0) if prefix not in inner else -1
        if left == 0:
            out.append(_pack(prefix, held, 0))
            return
        depth = len(prefix) + 1
        cuts = np.searchsorted(held[0], np.array([_code(prefix + c) << 2 * (k - depth) for c in "ACGT"], np.uint64))
        for c, a, b in zip("ACGT", cuts, [*cuts[1:], len(held[0])]):
            if a < b:
                split(prefix + c, tuple(x[a:b] for x in held), out, left - 1 if left > 0 else -1)

    def batches(it):
        for batch in it:
            out: list[dict] = []
            for x in batch.to_pylist():
                if x["n"]:
                    split(x["prefix"], _unpack(x), out)
            yield _rows(out)

    return batches


def _deeper(cut: dict[str, int], k: int) -> dict[str, int]:
    """For each prefix that may hold more than MERGED terms, how many more letters part them; its leaves may be handed over under shorter prefixes too."""
    out = {}
    for prefix in cut:
        n = cut[prefix] + sum(cut.get(prefix[:i], 0) for i in range(len(prefix)))
        letters = 0
        while n > MERGED << 2 * letters and len(prefix) + letters < k:
            letters += 1
        if letters:
            out[prefix] = letters
    return out


def _join(k: int):
    def group(key, table):
        term, occ, rec = _merge([_unpack(x) for x in table.to_pylist()])
        letters = LETTERS[((term[:, None] >> np.arange(2 * k - 2, -1, -2, dtype=np.uint64)) & np.uint64(3)).astype(np.intp)]
        spelt = pa.Array.from_buffers(pa.string(), len(term), [None, pa.py_buffer(np.arange(0, k * len(term) + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters))])
        return pa.table({"term": spelt, "occurrences": occ, "records": rec})

    return group


def term_counts(df: DataFrame, seq: str, k: int = 9, rare_per: int = 20_000, common_percent: int = 5, burst: int = 4096) -> DataFrame:
    """(term, occurrences, records, mark) of every term of ``k`` <= 20 letters without N.

    ``mark``: ``rare`` for one record or at most n / rare_per, else ``common``
    for at least common_percent % of n, else null; n is the number of rows with
    a sequence.
    """
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    leaves = written(take(df, seq=seq).mapInArrow(_grow(k, burst), _LEAF), "terms")
    n = leaves.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # At most 4**ROUTE_DEPTH prefixes come to the driver.
    cut = {r[0]: r[1] for r in leaves.where("n > 0").groupBy(F.substring("prefix", 1, ROUTE_DEPTH)).agg(F.sum("n")).collect()}
    inner = frozenset(p[:i] for p in cut for i in range(len(p)))
    routed = leaves.where("n > 0").mapInArrow(_route(k, inner, _deeper(cut, k)), _LEAF)
    terms = routed.groupBy("prefix").applyInArrow(_join(k), "term string, occurrences long, records long")
    rare = (F.col("records") == 1) | (F.col("records") * rare_per <= n)
    return terms.withColumn("mark", F.when(rare, "rare").when(F.col("records") * 100 >= n * common_percent, "common"))
