"""Consensus of a graph: one sequence a cluster of reads, with coverage and quality."""

from __future__ import annotations

import math
from dataclasses import dataclass

from braidwork.kernels.cluster import clusters
from braidwork.kernels.lattice import SINK, SOURCE, Lattice
from braidwork.kernels.params import Consensus, Params


@dataclass
class Called:
    reads: list[int]
    nodes: list[int]
    bases: list[int]
    cover: list[int]
    quality: list[int]


def phred(cover: int, n: int) -> int:
    """Quality character of a base that ``cover`` of ``n`` reads support."""
    if cover > n:
        raise ValueError("more support than reads")
    p = 1.0 - 1.0 / (1.0 + math.exp(-13.8 * (1.25 * cover / n - 0.25)))
    return 33 + int(-10.0 * math.log10(p) + 0.499)


class _Cluster:
    def __init__(self, graph: Lattice, reads: list[int] | None, use_quality: bool):
        self.g, self.reads = graph, reads if reads is not None else list(range(graph.n_seq))
        self.bits = None if reads is None else sum(1 << r for r in reads)
        self.use_quality = use_quality

    def weight(self, a: int, i: int) -> int:
        """Of the i-th edge out of a."""
        if self.bits is None:
            return self.g.out_weight[a][i]
        shared = self.g.out_reads[a][i] & self.bits
        if self.use_quality and a in self.g.read_weight:
            return sum(w for r, w in self.g.read_weight[a].items() if shared >> r & 1)
        return shared.bit_count()

    def cover(self, a: int) -> int:
        if self.bits is None:
            return self.g.n_reads[a]
        return sum((x & self.bits).bit_count() for x in self.g.out_reads[a])


def _heaviest(g: Lattice, c: _Cluster) -> tuple[list[int], list[int]]:
    """The path of heaviest edges; of equals the one whose rest weighs more, and of equal rests the later edge."""
    score, follow = [0] * len(g), [SINK] * len(g)
    for x in reversed(g.node_at):
        if x in (SOURCE, SINK):
            continue
        w, rest, i = max((c.weight(x, i), score[y], i) for i, y in enumerate(g.out[x]))
        score[x], follow[x] = w + rest, g.out[x][i]
    _, _, i = max((c.weight(SOURCE, i), score[y], -i) for i, y in enumerate(g.out[SOURCE]))
    at, path = g.out[SOURCE][-i], []
    while at != SINK:
        path.append(at)
        at = follow[at]
    return path, [c.cover(x) for x in path]


def _frequent(g: Lattice, c: _Cluster, m: int, spanning: bool) -> tuple[list[int], list[int]]:
    """For each column the most frequent known letter, kept where gaps are not more frequent."""
    rank = g.ranks()
    columns: dict[int, list[int]] = {}
    for x in range(2, len(g)):
        columns.setdefault(rank[x], []).append(x)
    path, cover = [], []
    for r in sorted(columns):
        counts = {x: c.cover(x) for x in columns[r] if g.base[x] < m - 1}
        total = sum(counts.values())
        if not total:
            continue
        best = min(counts, key=lambda x: (-counts[x], g.base[x]))
        gaps = (g.n_span[best] if spanning else len(c.reads)) - total
        if counts[best] >= gaps:
            path.append(best)
            cover.append(counts[best])
    return path, cover


def call(graph: Lattice, params: Params) -> list[Called]:
    """One consensus, or one for each cluster of reads."""
    if graph.empty:
        return []
    parts = clusters(graph, params.m, params.max_consensus, params.min_freq) if params.max_consensus > 1 else None
    out = []
    for reads in parts or [None]:
        c = _Cluster(graph, reads, params.use_quality)
        if params.consensus is Consensus.HEAVIEST:
            path, cover = _heaviest(graph, c)
        else:
            path, cover = _frequent(graph, c, params.m, params.spanning_only)
        n = len(c.reads)
        out.append(Called(c.reads, path, [graph.base[x] for x in path], cover, [phred(min(x, n), n) for x in cover]))
    return out
