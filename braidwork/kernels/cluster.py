"""Read clusters of one group, from the alignment matrix of its reads."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from braidwork.kernels.lattice import Lattice

ROUNDS, SHARE = 10, 0.8


def matrix(graph: Lattice, gap: int) -> np.ndarray:
    """Reads by columns, letter codes, the gap where a read has none."""
    cells = graph.cells()
    out = np.full((len(cells), graph.n_columns()), gap, np.int16)
    for r, row in enumerate(cells):
        for c, b in row:
            out[r, c] = b
    return out


@dataclass
class Site:
    column: int
    depth: int
    indel: bool
    count: int
    alleles: list[int]  # letters, by the first read that has them
    reads: list[np.ndarray]
    of_read: np.ndarray  # place among the alleles, or -1

    @property
    def weight(self) -> int:
        return (1 if self.indel else 2) * self.count


def sites(msa: np.ndarray, gap: int, least: int) -> list[Site]:
    """Columns with two or more alleles that enough reads have and enough lack; equal partitions of the reads count as one."""
    n = len(msa)
    found: list[Site] = []
    seen: dict[tuple, Site] = {}
    for c in range(msa.shape[1]):
        col = msa[:, c]
        values, first, counts = np.unique(col, return_index=True, return_counts=True)
        kept = (counts >= least) & (counts <= n - least)
        if kept.sum() < 2:
            continue
        order = np.argsort(first[kept], kind="stable")
        alleles = [int(v) for v in values[kept][order]]
        reads = [np.flatnonzero(col == v) for v in alleles]
        indel = gap in alleles
        key = tuple(x.tobytes() for x in reads)
        if key in seen:
            seen[key].count += 1
            seen[key].indel &= indel
            continue
        of_read = np.full(n, -1)
        for i, x in enumerate(reads):
            of_read[x] = i
        seen[key] = Site(c, int(counts[kept].sum()), indel, 1, alleles, reads, of_read)
        found.append(seen[key])
    return found


def distances(found: list[Site], n: int) -> np.ndarray:
    """Between reads: weights of the sites at which both have an allele, and not the same."""
    d = np.zeros((n, n), np.int64)
    for s in found:
        a = s.of_read
        d += s.weight * ((a[:, None] != a[None, :]) & (a[:, None] >= 0) & (a[None, :] >= 0))
    return d


def _two(site: Site, d: np.ndarray) -> list[int]:
    """The farthest two reads with different alleles."""
    best, pick = 0, []
    for i in range(len(site.reads)):
        for j in range(i + 1, len(site.reads)):
            part = d[np.ix_(site.reads[i], site.reads[j])]
            top = int(part.max(initial=0))
            if top > best:
                a, b = np.unravel_index(int(part.argmax()), part.shape)
                best, pick = top, [int(site.reads[i][a]), int(site.reads[j][b])]
    return pick


def _one(found: list[Site], at: int, d: np.ndarray, medoids: list[int]) -> list[int]:
    """A read whose alleles at the sites so far no medoid has, of the largest such part; else the one farthest from all."""
    n = len(d)
    near = d[:, medoids].min(1)
    parts = [tuple(int(s.of_read[i]) for s in found[: at + 1]) for i in range(n)]
    sizes: dict[tuple, int] = {}
    for x in parts:
        sizes[x] = sizes.get(x, 0) + 1
    used = {parts[m] for m in medoids}
    pick, most, far = None, -1, 0
    for i in range(n):
        if parts[i] not in used and (sizes[parts[i]], near[i]) > (most, far):
            pick, most, far = i, sizes[parts[i]], int(near[i])
    if pick is not None:
        return [pick]
    far = 0
    for reads in found[at].reads:
        for i in reads:
            if int(i) not in medoids and near[i] > far:
                pick, far = int(i), int(near[i])
    return [] if pick is None else [pick]


def _seeds(found: list[Site], order: list[int], d: np.ndarray, k: int) -> list[int]:
    medoids: list[int] = []
    for nth, at in enumerate(order):
        if len(medoids) >= k:
            break
        if nth == 0:
            medoids = _two(found[at], d)
            while medoids and len(medoids) < min(len(found[at].alleles), k):
                more = _one(found, at, d, medoids)
                if not more:
                    break
                medoids += more
            if not medoids:
                continue
        elif not medoids:
            medoids = _two(found[at], d)
        else:
            medoids += _one(found, at, d, medoids)
    return medoids


def _assign(d: np.ndarray, medoids: list[int]) -> list[list[int]]:
    """Nearest medoid; a tie, whatever its medoids, goes to the smaller of the first two clusters."""
    out: list[list[int]] = [[] for _ in medoids]
    for i in range(len(d)):
        row = d[i, medoids]
        j = int(row.argmin())
        # a later equal distance is a tie unless a smaller one follows
        if (row[j + 1 :] == row[j]).any():
            j = 0 if len(out[0]) < len(out[1]) else 1
        out[j].append(i)
    return out


def clusters(graph: Lattice, gap: int, k: int, min_freq: float) -> list[list[int]] | None:
    """Up to k clusters of reads, or None if the reads are of one kind."""
    n = graph.n_seq
    least = max(2, math.ceil(n * min_freq))
    if n < 2 or k < 2:
        return None
    msa = matrix(graph, gap)
    found = sites(msa, gap, max(2, least // 2))
    if not found:
        return None
    order = sorted(range(len(found)), key=lambda i: (-found[i].count, -found[i].depth, found[i].indel))
    d = distances(found, n)
    while k >= 2:
        medoids = _seeds(found, order, d, k)
        if not medoids:
            return None
        if len(medoids) == k:
            parts: list[list[int]] = []
            for _ in range(ROUNDS):
                parts = _assign(d, medoids)
                new = [x[int(d[np.ix_(x, x)].sum(1).argmin())] if x else -1 for x in parts]
                new.sort()
                if new[0] == -1 or new == medoids:
                    break
                medoids = new
            if all(len(x) >= least for x in parts) and sum(map(len, parts)) >= math.ceil(n * SHARE):
                return parts
        k -= 1
    return None
