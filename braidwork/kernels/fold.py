"""The fold of a group's reads, one after another, into its graph."""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from braidwork.kernels import seed
from braidwork.kernels.align import Alignment, Request, align_many, cells_needed
from braidwork.kernels.lattice import SINK, SOURCE, Lattice, swap_sorted
from braidwork.kernels.params import Mode, Params


@dataclass
class Folded:
    graph: Lattice
    order: list[int]  # place in the input of each read of the graph
    reversed: list[bool]
    scores: list[int]


def complement(codes: np.ndarray) -> np.ndarray:
    """Reverse complement; what is no nucleotide becomes unknown."""
    back = codes[::-1]
    return np.where(back < 4, 3 - back.astype(np.int16), 4).astype(np.uint8)


def weights_of(qual: str | list[int] | None, n: int, use_quality: bool) -> np.ndarray:
    """Weights given for each letter, or quality character - 32, or 1."""
    if not use_quality or qual is None or len(qual) != n:
        return np.ones(n, np.int64)
    if not isinstance(qual, str):
        return np.array([0 if x is None else x for x in qual], np.int64)
    return np.frombuffer(qual.encode("latin-1", "replace"), np.uint8).astype(np.int64) - 32


LANES = 32  # groups folded side by side
CELLS = 5_000_000  # kept at a time in one round, about

Reads = list[tuple[str, "str | Weights | None"]]
Weights = list[int]


def fold(reads: Reads, params: Params, graph: Lattice | None = None) -> Folded:
    """``reads``: (sequence, quality or weights) in the order in which they are added, to ``graph`` if given."""
    return next(fold_many([(reads, graph)], params))


def fold_many(groups: Iterable[tuple], params: Params) -> Iterator[Folded]:
    """The fold of each group (reads, graph or None, and for ``_between`` the node spans), in their order.

    A group's reads follow one another, so each round aligns one read of every
    group in flight. ``groups`` is read only as far as there is room.
    """
    waiting, flight, done, given, taken = iter(groups), {}, {}, 0, 0
    more = True
    while more or flight or done:
        while more and len(flight) < LANES and taken - given < 4 * LANES:
            try:
                reads, graph, *spans = next(waiting)
            except StopIteration:
                more = False
                break
            steps = _between(reads, params, graph, *spans) if spans else _steps(reads, params, graph)
            _advance(flight, done, taken, steps, None)
            taken += 1
        while given in done:
            yield done.pop(given)
            given += 1
        room, batch = CELLS, []
        # a group that holds up the output goes first
        for i, (_, request) in sorted(flight.items()):
            need = cells_needed(request, params)
            if batch and need > room:
                continue
            batch.append(i)
            room -= need
        if batch:
            found = align_many([flight[i][1] for i in batch], params)
            for i, x in zip(batch, found):
                _advance(flight, done, i, flight.pop(i)[0], x)


def _advance(flight: dict, done: dict, i: int, steps, answer) -> None:
    try:
        flight[i] = (steps, steps.send(answer))
    except StopIteration as end:
        done[i] = end.value


def _steps(reads: Reads, params: Params, graph: Lattice | None) -> Generator[Request, Alignment, Folded]:
    """One group's fold; asks for alignments as it needs them."""
    graph = graph or Lattice()
    order = list(range(len(reads)))
    if params.longest_first:
        swap_sorted([len(reads[i][0]) for i in order], order)
    codes = [params.encode(reads[i][0]) for i in order]
    weights = [weights_of(reads[i][1], len(reads[i][0]), params.use_quality) for i in order]
    base = graph.n_seq
    graph.n_seq += len(reads)
    out = Folded(graph, order, [False] * len(reads), [0] * len(reads))
    keep = params.use_quality and params.max_consensus > 1
    if params.mode is Mode.GLOBAL and (params.seeding or params.progressive) and len(reads) > 1 and base == 0:
        yield from _anchored(out, codes, weights, params, keep)
        return out
    best_letter = int(params.scores().max())
    for i, (q, w) in enumerate(zip(codes, weights)):
        if not len(q):
            continue
        found = _NOTHING
        if not graph.empty:
            found = yield Request(graph, q)
            if params.both_strands and found.score < min(len(q), len(graph) - 2) * best_letter * 0.3333:
                back = complement(q)
                other = yield Request(graph, back)
                if other.score > found.score:
                    found, q, w = other, back, w[::-1]
                    out.reversed[i] = True
        out.scores[i] = found.score if found.steps else 0
        graph.fuse(q, w, found.steps, base + i, keep_weight=keep)
    return out


def _between(reads: Reads, params: Params, graph: Lattice | None, spans: list[tuple[int, int] | None]) -> Generator[Request, Alignment, Folded]:
    """Reads that belong to a part of the graph: each is aligned to the closed part around its first and last node only.

    A read without a span, and the first of an empty graph, goes to the whole graph.
    """
    graph = graph or Lattice()
    out = Folded(graph, list(range(len(reads))), [False] * len(reads), [0] * len(reads))
    base = graph.n_seq
    graph.n_seq += len(reads)
    for i, ((seq, qual), span) in enumerate(zip(reads, spans)):
        q = params.encode(seq)
        if not len(q):
            continue
        begin, end = SOURCE, SINK
        if span is not None and not graph.empty:
            if not 2 <= min(span) <= max(span) < len(graph) or graph.index[span[0]] > graph.index[span[1]]:
                raise ValueError(f"no part of the graph from node {span[0]} to node {span[1]}")
            begin, end = graph.region(*span)
        found = _NOTHING if graph.empty else (yield Request(graph, q, begin, end))
        out.scores[i] = found.score if found.steps else 0
        graph.fuse(q, weights_of(qual, len(seq), params.use_quality), found.steps, base + i, begin, end, both_ends=(begin, end) == (SOURCE, SINK))
    return out


_NOTHING = Alignment(-1)


def _window(graph: Lattice, q: np.ndarray, begin: int, end: int) -> Generator[Request, Alignment, Alignment]:
    if not len(q):
        return Alignment(0)
    return (yield Request(graph, q, begin, end))


def _anchored(out: Folded, codes: list[np.ndarray], weights: list[np.ndarray], params: Params, keep: bool) -> Generator[Request, Alignment, None]:
    """Reads in guide order; between anchors with the read before, each window is aligned by itself."""
    graph, k, n = out.graph, params.k, len(codes)
    sketches = [seed.minimisers(c, params) for c in codes]
    order = list(range(n))
    if params.progressive and n > 2 and any(len(s.hash) for s in sketches):
        order = seed.guide_order(seed.likeness(sketches))
    last_nodes: list[int] = []
    for nth, i in enumerate(order):
        q, w = codes[i], weights[i]
        links: list[tuple[int, int, int]] = []
        if params.seeding and nth:
            t = order[nth - 1]
            links = seed.chain(seed.anchors(sketches[t], sketches[i], len(q), k), k, params.min_window + k, len(codes[t]), len(q))
            if links and not last_nodes:
                links = []
        if links:
            back = out.reversed[t]
            out.reversed[i] = back ^ bool(links[0][0])
            if out.reversed[i]:
                q, w = complement(q), w[::-1]
            if back:  # anchors name places on the forward reads; both are now read backwards
                links = [(s, len(codes[t]) - a + k - 2, len(q) - b + k - 2) for s, a, b in reversed(links)]
        if not len(q):
            continue
        steps: list[tuple[str, int, int]] = []
        score, begin, at = 0, SOURCE, 0
        if not graph.empty:
            for _, a, b in links:
                start, here = a - k + 1, b - k + 1
                part = yield from _window(graph, q[at:here], begin, last_nodes[start])
                steps += part.steps + [("M", x, 1) for x in last_nodes[start : start + k]]
                score += part.score
                begin, at = last_nodes[start + k - 1], here + k
            part = yield from _window(graph, q[at:], begin, SINK)
            steps += part.steps
            score += part.score
        out.scores[i] = score
        last_nodes = graph.fuse(q, w, steps, i, keep_weight=keep)
