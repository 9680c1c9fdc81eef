"""Alignment of sequences to graphs, of many groups at once.

A row belongs to a node and spans the band of read positions worth a look. A
row's level is the longest way to it from the start, so rows of one level do
not need one another, in one graph or in many. A round takes one read each of
many graphs, orders all rows by level, and computes level after level: some
forty array operations a level, whatever the number of graphs. Only banded
cells are kept, with a sentinel on either side of each row that stands for all
cells outside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

from braidwork.kernels.lattice import SINK, SOURCE, Lattice
from braidwork.kernels.params import Gap, Mode, Params

NEG = -(1 << 28)
_LOW = NEG // 2
_SLACK = 4096  # cells of padding that do not matter


@dataclass
class Alignment:
    score: int
    steps: list[tuple[str, int, int]] = field(default_factory=list)
    n_aligned: int = 0
    n_matched: int = 0
    node_start: int = -1
    node_end: int = -1
    query_start: int = -1
    query_end: int = -1


@dataclass
class Request:
    """A read to be aligned to what lies between two nodes of a graph, both excluded."""

    graph: Lattice
    query: np.ndarray
    begin: int = SOURCE
    end: int = SINK


def path_scores(graph: Lattice, node: int) -> list[int]:
    """For each edge into a node, the rounded log of its part of what leaves its start, at least -20."""
    out = []
    for a, w in zip(graph.into[node], graph.into_weight[node]):
        total = sum(graph.out_weight[a])
        x = math.log(w / total) if w and total else 0.0
        out.append(max(-20, int(math.copysign(math.floor(abs(x) + 0.5), x))))
    return out


def align(graph: Lattice, query: np.ndarray, params: Params, begin: int = SOURCE, end: int = SINK) -> Alignment:
    """The best alignment between begin and end, both excluded."""
    return align_many([Request(graph, query, begin, end)], params)[0]


def align_many(requests: list[Request], params: Params) -> list[Alignment]:
    """The best alignment of each request; the result of one does not depend on the others."""
    out = [Alignment(-1)] * len(requests)
    some = [i for i, r in enumerate(requests) if not r.graph.empty]
    if some:
        for i, found in zip(some, _Round([_Lane(requests[i], params) for i in some], params).run()):
            out[i] = found
    return out


_pool: dict[int, np.ndarray] = {}


def _kept(planes: int, size: int) -> np.ndarray:
    """Room for cells, taken over from the round before where it is large enough and not far too large."""
    old = _pool.get(planes)
    if old is None or not size <= old.shape[1] <= 8 * size + (1 << 20):
        old = _pool[planes] = np.empty((planes, max(1 << 12, size)), np.int32)
    return old


def cells_needed(request: Request, params: Params) -> int:
    """About how many cells a request keeps."""
    n = len(request.query)
    width = n if params.band < 0 else min(n, 2 * (params.band + int(params.band_part * n)) + 40)
    return len(request.graph) * (width + 3)


class _Lane:
    """One request: its nodes in order, their levels and the rows before each."""

    def __init__(self, request: Request, params: Params):
        g = self.g = request.graph
        if g.stale:
            g.order()
        self.q, self.begin, self.end = request.query, request.begin, request.end
        self.n = len(self.q)
        first, last = g.index[self.begin], g.index[self.end]
        nodes, into = g.node_at[first:last], g.into
        if self.begin != SOURCE or self.end != SINK:  # only what can be reached from the start
            live = {self.begin}
            for x in nodes[1:]:
                if any(a in live for a in into[x]):
                    live.add(x)
            nodes = [x for x in nodes if x in live]
            before = [[]] + [[a for a in into[x] if a in live] for x in nodes[1:]]
        else:
            before = [[]] + [into[x] for x in nodes[1:]]
        self.nodes = nodes
        level = [0] * len(g)
        for x, p in zip(nodes[1:], before[1:]):
            level[x] = (level[p[0]] if len(p) == 1 else max([level[a] for a in p])) + 1
        at = np.array(nodes, np.int64)
        row_of = np.full(len(g), -1, np.int64)
        row_of[at] = np.arange(len(nodes))
        self.row_of = row_of
        self.level = np.array(level, np.int64)[at]
        self.count = np.fromiter(map(len, before), np.int64, len(nodes))
        flat = np.fromiter(chain.from_iterable(before), np.int64, int(self.count.sum()))
        row = np.repeat(np.arange(len(nodes)), self.count)
        self.nth = np.arange(len(flat)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.row, self.pre = row, row_of[flat]
        self.before = before
        self.cost = None
        if params.path_score:
            kept = [[c for a, c in zip(into[x], path_scores(g, x)) if row_of[a] >= 0] for x in nodes[1:]]
            self.cost = np.fromiter(chain.from_iterable(kept), np.int32, len(flat))
        remain = np.array(g.remain, np.int64)
        self.reach = self.n - (remain[at] - g.remain[self.end] - 1)
        self.base = np.array(g.base, np.int64)[at]


class _Round:
    def __init__(self, lanes: list[_Lane], params: Params):
        self.lanes, self.p = lanes, params
        self.local, self.extend = params.mode is Mode.LOCAL, params.mode is Mode.EXTEND
        self.banded = params.band >= 0
        self.pieces = params.pieces
        k = len(self.pieces)
        self.planes = 1 + 2 * k
        sizes = np.array([len(x.nodes) for x in lanes])
        starts = np.cumsum(sizes) - sizes
        level, count = np.concatenate([x.level for x in lanes]), np.concatenate([x.count for x in lanes])
        order = np.argsort(level, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = np.split(place, starts[1:])
        level = level[order]
        self.levels = np.concatenate((np.searchsorted(level, np.arange(int(level[-1]) + 1)), [len(order)])).tolist()
        # the rows before each row, one after another, from first[row] to first[row + 1]
        self.count = count[order]
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        to, nth = place[np.concatenate([x.row + s for x, s in zip(lanes, starts)])], np.concatenate([x.nth for x in lanes])
        at = self.first[to] + nth
        self.pre = np.empty(len(at), np.int64)
        self.pre[at] = place[np.concatenate([x.pre + s for x, s in zip(lanes, starts)])]
        self.cost = None
        if params.path_score:
            self.cost = np.empty(len(at), np.int32)
            self.cost[at] = np.concatenate([x.cost for x in lanes])
        n = np.array([x.n for x in lanes])
        w = np.array([params.band + int(params.band_part * x.n) for x in lanes]) if self.banded else n
        each = lambda x: np.repeat(x, sizes)[order]
        self.n, w_each = each(n), each(w)
        reach = np.concatenate([x.reach for x in lanes])[order]
        # what the band starts and stops at by itself, and what it adds to where the rows before did best
        self.reach_low, self.reach_high, self.low, self.high = reach - w_each, reach + w_each, 1 - w_each, 1 + w_each
        self.scores = params.scores()
        wide = int(n.max()) + 2
        query = np.concatenate([np.concatenate(([0], x.q)) for x in lanes] + [np.zeros(wide, np.int64)]).astype(np.int64)
        self.letters = np.ascontiguousarray(self.scores[:, query]).astype(np.int32)
        self.letters[:, np.cumsum(n + 1) - (n + 1)] = 0
        # where the score of a row's letter against no letter of the read lies
        self.letter_at = np.concatenate([x.base for x in lanes])[order] * len(query) + each(np.cumsum(n + 1) - (n + 1))
        self.letters = self.letters.reshape(-1)
        rows = len(order)
        # where each row's cell of position beg lies, and how many cells it has
        self.stop = np.full(rows, -1, np.int64)
        self.at, self.width = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.top = np.full(rows, NEG, np.int64)
        # first place of each row's best score, last place (negative), and start of the band
        self.band = np.full((3, rows), -1, np.int64)
        self.lo, self.not_hi, self.beg = self.band
        self.not_hi[:], self.beg[:] = 1, 0
        guess = int((sizes * (np.minimum(n, 2 * w + 40) + 3)).sum())
        self.cells, self.used = _kept(self.planes, guess), 0
        self.ext = np.array([e for _, e in self.pieces], np.int32)[:, None, None]
        self.open = np.array([oe for oe, _ in self.pieces], np.int32)[:, None, None]
        at = np.arange(wide + 2, dtype=np.int32)
        self.slope = at * self.ext if self.pieces else at * np.int32(params.gap_extend[0])
        self.shift = self.slope + self.open - self.ext if self.pieces else None
        self.span = np.arange(-1, wide + 2)
        self.compute = {Gap.LINEAR: self._linear, Gap.AFFINE: self._affine, Gap.CONVEX: self._convex}[params.gap]

    def run(self) -> list[Alignment]:
        self._first_rows(self.levels[1])
        edges = self.first[self.levels].tolist()
        for a, b, ea, eb in zip(self.levels[1:-1], self.levels[2:], edges[1:-1], edges[2:]):
            self._level(a, b, ea, eb)
        at, beg, stop = self.at.tolist(), self.beg.tolist(), self.stop.tolist()
        flat = [self.cells[i] for i in range(self.planes)]
        return [self._trace(lane, place, *self._best(lane, place), at, beg, stop, flat) for lane, place in zip(self.lanes, self.place)]

    def _best(self, lane: _Lane, place: np.ndarray) -> tuple[int, int, int]:
        """Score, row among the lane's nodes, and read position at which the way back starts."""
        g, p = lane.g, self.p
        if p.mode is Mode.GLOBAL:
            best, row, j = NEG, 0, 0
            for x in g.into[lane.end]:
                r = int(lane.row_of[x])
                if r >= 0:
                    at = int(place[r])
                    here = min(lane.n, int(self.stop[at]))
                    v = self._cell(at, here)
                    if v > best:
                        best, row, j = v, r, here
            return best, row, j
        tops = self.top[place]
        tops[0] = NEG
        if self.local or p.zdrop <= 0:
            row = int(tops.argmax())
            at = place[row]
            return (int(tops[row]), row, int(self.lo[at] if self.local else -self.not_hi[at])) if row else (NEG, 0, 0)
        best, best_row, best_j, best_node = NEG, 0, 0, lane.begin
        for row, (top, hi) in enumerate(zip(tops.tolist(), (-self.not_hi[place]).tolist())):
            if row == 0:
                continue
            if top > best:
                best, best_row, best_j, best_node = top, row, hi, lane.nodes[row]
            else:
                delta = g.remain[best_node] - g.remain[lane.nodes[row]]
                if best - top > p.zdrop + p.gap_extend[0] * abs(delta - (hi - best_j)):
                    break
        return best, best_row, best_j

    # Rows -------------------------------------------------------------------------------

    def _room(self, rows, n: int, width: int) -> np.ndarray:
        """Cells for n rows of one padded width, with a sentinel on each side."""
        size = n * (width + 2)
        if self.used + size > self.cells.shape[1]:
            old, self.cells = self.cells, _kept(self.planes, max(self.used + size, self.cells.shape[1] * 3 // 2))
            self.cells[:, : self.used] = old[:, : self.used]
        part = self.cells[:, self.used : self.used + size].reshape(self.planes, n, width + 2)
        part[:, :, 0] = part[:, :, -1] = NEG
        self.at[rows] = np.arange(self.used + 1, self.used + 1 + size, width + 2)
        self.used += size
        return part[:, :, 1:-1]

    def _cell(self, row: int, j: int) -> int:
        return int(self.cells[0, self.at[row] + j - self.beg[row]]) if self.beg[row] <= j <= self.stop[row] else 2 * NEG

    def _first_rows(self, n: int) -> None:
        rows = slice(0, n)
        stop = np.minimum(self.n[rows], np.maximum(self.high[rows] - 1, self.reach_high[rows])) if self.banded else self.n[rows]
        self.stop[rows], self.width[rows] = stop, stop + 1
        self.lo[rows] = self.not_hi[rows] = 0
        wide = int(stop.max()) + 1
        room = self._room(rows, n, wide)
        k = len(self.pieces)
        room[:] = 0 if self.local else NEG
        if not self.local:
            j = np.arange(1, wide, dtype=np.int32)
            if k == 0:
                room[0, :, 1:] = -self.p.gap_extend[0] * j
            else:
                for i, (oe, e) in enumerate(self.pieces):
                    room[1 + i, :, 0] = -oe
                    room[1 + k + i, :, 1:] = -(oe - e) - e * j
                room[0, :, 1:] = room[1 + k :, :, 1:].max(0)
            room[0, :, 0] = 0
        np.copyto(room, NEG, where=np.arange(wide) > stop[:, None])

    def _level(self, a: int, b: int, ea: int, eb: int) -> None:
        """Bands of the rows of one level, then their cells, in parts of about the same width."""
        pre = self.pre[ea:eb]
        starts = self.first[a:b] - ea if eb - ea > b - a else None
        if self.banded:
            x = self.band.take(pre, axis=1)
            if starts is not None:
                x = np.minimum.reduceat(x, starts, axis=1)
            beg, stop, low = x
            beg += self.low[a:b]
            np.minimum(beg, self.reach_low[a:b], out=beg)
            np.maximum(beg, low, out=beg)
            np.maximum(beg, 0, out=beg)
            np.subtract(self.high[a:b], stop, out=stop)
            np.maximum(stop, self.reach_high[a:b], out=stop)
            np.minimum(stop, self.n[a:b], out=stop)
            self.beg[a:b], self.stop[a:b] = beg, stop
            width = stop - beg
            width += 1
        else:
            self.stop[a:b] = self.n[a:b]
            width = self.n[a:b] + 1
        most, least = int(width.max()), int(width.min())
        if least > 0 and (least == most or most * (b - a) <= 2 * int(width.sum()) + _SLACK):
            self.width[a:b] = width
            self._block(slice(a, b), pre, starts, self.cost[ea:eb] if self.cost is not None else None, most)
            return
        self.width[a:b] = np.maximum(width, 0)
        size = np.where(width > 0, np.frexp(width.astype(np.float64))[1], 0)
        for s in np.unique(size).tolist():
            if s > 0:
                rows = np.flatnonzero(size == s) + a
                n = self.first[rows + 1] - self.first[rows]
                starts = np.cumsum(n) - n
                edges = np.repeat(self.first[rows] - starts, n) + np.arange(int(n.sum()))
                self._block(rows, self.pre[edges], starts if len(edges) > len(rows) else None, self.cost[edges] if self.cost is not None else None, int(width[rows - a].max()))

    def _block(self, rows, pre: np.ndarray, starts: np.ndarray | None, cost: np.ndarray | None, width: int) -> None:
        """``pre``: the rows before, one row's after another's, which start at ``starts`` (None: each has one)."""
        beg, wide = self.beg[rows], self.width[rows]
        n = len(beg)
        span = self.span[1 : width + 1]
        s = self.letters.take((self.letter_at[rows] + beg)[:, None] + span)
        outside = span >= wide[:, None] if n > 1 and int(wide.min()) < width else None
        zero = np.flatnonzero(beg == 0) if int(beg.min()) == 0 else None
        room = self._room(rows, n, width)
        # where the cells of the rows before lie, from one position in front
        if starts is None:
            at = beg - self.beg.take(pre)
        else:
            at = beg.repeat(self.count[rows]) - self.beg.take(pre)
        at = at[:, None] + self.span[: width + 1]
        np.maximum(at, -1, out=at)
        np.minimum(at, self.width.take(pre)[:, None], out=at)
        at += self.at.take(pre)[:, None]
        self.compute(room, at, starts, None if cost is None else cost[:, None], s, outside, zero)
        if self.banded or self.p.mode is not Mode.GLOBAL:
            h = room[0]
            first = h.argmax(1)
            top = h[np.arange(n), first]
            last = h[:, ::-1].argmax(1)
            some = top > _LOW
            if some.all():
                self.top[rows] = top
                self.lo[rows] = first + beg
                self.not_hi[rows] = last - beg - (width - 1)
            else:
                self.top[rows], self.lo[rows], self.not_hi[rows] = np.where(some, top, NEG), np.where(some, beg + first, -1), np.where(some, last - beg - (width - 1), 1)

    def _from(self, at, starts, cost, s: np.ndarray, zero) -> tuple[np.ndarray, np.ndarray]:
        """Best over the rows before: letter against letter, and each open gap."""
        got = self.cells[: 1 + len(self.pieces)].take(at, axis=1)
        if cost is not None:
            got += cost
        if starts is not None:
            got = np.maximum.reduceat(got, starts, axis=1)
        if zero is not None and self.local:
            got[0, zero, 0] = 0
        m = got[0, :, :-1]
        m += s
        if zero is not None and not self.local:
            m[zero, 0] = NEG
        return m, got[1:, :, 1:]

    def _gaps(self, over: np.ndarray, f: np.ndarray) -> None:
        """Insertions that start from the given scores, into f (pieces, rows, positions)."""
        width = over.shape[-1]
        run = over + self.slope[:, :, :width]
        np.maximum.accumulate(run, axis=2, out=run)
        f[:, :, 0] = NEG
        np.subtract(run[:, :, :-1], self.shift[:, :, 1:width], out=f[:, :, 1:])

    def _leave(self, gap: np.ndarray, h: np.ndarray, room: np.ndarray) -> None:
        """Deletions that go on or start here."""
        out = room[1 : 1 + len(self.pieces)]
        np.subtract(gap, self.ext, out=out)
        np.maximum(out, h - self.open, out=out)
        if self.local:
            np.maximum(out, 0, out=out)

    def _convex(self, room, at, starts, cost, s, outside, zero) -> None:
        over, gap = self._from(at, starts, cost, s, zero)
        for x in gap:
            np.maximum(over, x, out=over)
        if outside is not None:
            np.copyto(over, NEG, where=outside)
        f, h = room[1 + len(self.pieces) :], room[0]
        self._gaps(over, f)
        np.maximum(over, f[0], out=h)
        for x in f[1:]:
            np.maximum(h, x, out=h)
        if self.local:
            np.maximum(h, 0, out=h)
        self._leave(gap, h, room)
        if outside is not None:
            np.copyto(room[: 1 + len(self.pieces)], NEG, where=outside)

    def _affine(self, room, at, starts, cost, s, outside, zero) -> None:
        m, gap = self._from(at, starts, cost, s, zero)
        over = np.maximum(m, gap[0])
        if outside is not None:
            np.copyto(m, NEG, where=outside)
            np.copyto(over, NEG, where=outside)
        f, h = room[2], room[0]
        self._gaps(m, room[2:])
        np.maximum(over, f, out=h)
        if self.local:
            np.maximum(h, 0, out=h)
        self._leave(gap, h, room)
        np.copyto(room[1], 0 if self.local else NEG, where=f > over)
        if outside is not None:
            np.copyto(room[:2], NEG, where=outside)

    def _linear(self, room, at, starts, cost, s, outside, zero) -> None:
        step, width = self.p.gap_extend[0], s.shape[1]
        one = self.cells[0].take(at)
        if cost is not None:
            one += cost
        if starts is not None:
            one = np.maximum.reduceat(one, starts, axis=0)
        h = one[:, :-1] + s
        if zero is not None:
            h[zero, 0] = 0 if self.local else NEG
        np.maximum(h, one[:, 1:] - step, out=h)
        if outside is not None:
            np.copyto(h, NEG, where=outside)
        slope = self.slope[:width]
        h += slope
        np.maximum.accumulate(h, axis=1, out=h)
        h -= slope
        if self.local:
            np.maximum(h, 0, out=h)
        room[0] = h
        if outside is not None:
            np.copyto(room[0], NEG, where=outside)

    # Way back ---------------------------------------------------------------------------

    def _trace(self, lane: _Lane, place: np.ndarray, best: int, first_row: int, first_j: int, at: list, beg: list, stop: list, flat: list) -> Alignment:
        g, p, n, q, nodes = lane.g, self.p, lane.n, lane.q.tolist(), lane.nodes
        k, step = len(self.pieces), p.gap_extend[0]
        places = place.tolist()
        H, scores, base, costs = flat[0].item, self.scores.tolist(), g.base, self.cost
        out = Alignment(best)
        steps: list[tuple[str, int, int]] = []

        def cell(plane: int, row: int, j: int) -> int:
            return flat[plane].item(at[row] + j - beg[row]) if beg[row] <= j <= stop[row] else 2 * NEG

        def insert(length: int) -> None:
            if steps and steps[-1][0] == "I":
                steps[-1] = ("I", -1, steps[-1][2] + length)
            else:
                steps.append(("I", -1, length))

        nth, before, nth_of = first_row, lane.before, lane.row_of.tolist()  # among the lane's nodes
        j, row, start = first_j, places[first_row], places[0]
        if j < n:
            insert(n - j)
        at_end = p.gap_at_end  # until the first gap, gaps go before matches
        may_match = not p.gap_on_right
        every = list(range(k))
        gaps_out = gaps_in = every
        closing = True  # whether a gap may close here, so that H counts
        last, last_j = nth, j
        aligned = matched = 0
        while row != start and j > 0:
            h = cell(0, row, j)
            if self.local and h == 0:
                break
            last, last_j = nth, j
            node = nodes[nth]
            letter = base[node]
            rows = before[nth]
            to, cost = -1, 0
            if closing:
                s = h - scores[letter][q[j - 1]]
                i = j - 1
                for nr, x in enumerate(rows):
                    x = nth_of[x]
                    r = places[x]
                    if costs is not None:
                        cost = int(costs[self.first[row] + nr])
                    if beg[r] <= i <= stop[r] and H(at[r] + i - beg[r]) + cost == s:
                        to = x
                        break
            if to < 0 or not may_match or at_end:
                found = None
                for nr, x in enumerate(rows):
                    x = nth_of[x]
                    r = places[x]
                    if costs is not None:
                        cost = int(costs[self.first[row] + nr])
                    if not beg[r] <= j <= stop[r]:
                        continue
                    if k == 0:
                        if cell(0, r, j) - step + cost == h:
                            found = x, True, -1
                            break
                        continue
                    for i in gaps_out:
                        oe, e = self.pieces[i]
                        v = cell(1 + i, r, j)
                        if (h == v + cost) if closing else (cell(1 + i, row, j) == v - e + cost):
                            found = x, cell(0, r, j) - oe == v, i
                            break
                    if found:
                        break
                if found:
                    nth, opened, i = found
                    steps.append(("D", node, 1))
                    row, at_end = places[nth], False
                    if k:
                        closing = opened
                        gaps_out, gaps_in = ([], every) if opened else ([i], [])
                    continue
                if k == 0:
                    if cell(0, row, j - 1) - step == h:
                        found = True, -1
                else:
                    for i in gaps_in:
                        oe, e = self.pieces[i]
                        f = cell(1 + k + i, row, j)
                        if closing and f != h:
                            continue
                        if cell(0, row, j - 1) - oe == f:
                            found = True, i
                            break
                        if cell(1 + k + i, row, j - 1) - e == f:
                            found = False, i
                            break
                if found:
                    opened, i = found
                    insert(1)
                    j, at_end = j - 1, False
                    aligned += 1
                    if k:
                        closing = opened
                        gaps_out, gaps_in = (every, []) if opened else ([], [i])
                    continue
                if to < 0:
                    raise RuntimeError("no way back from a cell")
                at_end = False
            steps.append(("M", node, 1))
            aligned += 1
            matched += letter == q[j - 1]
            nth, row, j = to, places[to], j - 1
            closing, gaps_out, gaps_in = True, every, every
        if j > 0:
            insert(j)
        steps.reverse()
        out.steps, out.n_aligned, out.n_matched = steps, aligned, matched
        out.node_end, out.query_end = nodes[first_row], first_j - 1
        out.node_start, out.query_start = nodes[last], last_j - 1
        return out
