"""The partial-order graph of a group of sequences.

Nodes are places in parallel lists. Edges keep their order, since ties in
alignment and consensus go by it; the reads on an edge are the bits of one
integer. Node 0 is the source and node 1 the sink.
"""

from __future__ import annotations

from collections import deque

SOURCE, SINK = 0, 1


def swap_sorted(weights: list[int], *others: list) -> None:
    """Descending by repeated swaps with each later larger weight; the order of equals matters, and this is the one meant."""
    n = len(weights)
    for j in range(n - 1):
        for k in range(j + 1, n):
            if weights[j] < weights[k]:
                for x in (weights, *others):
                    x[j], x[k] = x[k], x[j]


class Lattice:
    def __init__(self):
        self.base: list[int] = []
        self.into: list[list[int]] = []
        self.into_weight: list[list[int]] = []
        self.out: list[list[int]] = []
        self.out_weight: list[list[int]] = []
        self.out_reads: list[list[int]] = []
        self.column: list[list[int]] = []  # other nodes of the same alignment column
        self.n_reads: list[int] = []
        self.n_span: list[int] = []
        self.read_weight: dict[int, dict[int, int]] = {}
        self.n_seq = 0
        self.stale = True
        self.touched: set[int] = set()  # whose edges may be out of order
        for _ in range(2):
            self.add_node(-1)

    def __len__(self) -> int:
        return len(self.base)

    @property
    def empty(self) -> bool:
        return len(self.base) == 2

    def add_node(self, base: int, span: int = 0) -> int:
        for x in (self.into, self.into_weight, self.out, self.out_weight, self.out_reads, self.column):
            x.append([])
        self.base.append(base)
        self.n_reads.append(0)
        self.n_span.append(span)
        return len(self.base) - 1

    def add_edge(self, a: int, b: int, weight: int, read: int | None, fresh: bool = False, counted: bool = True, keep_weight: bool = False) -> None:
        """One more read from a to b. ``fresh``: there can be no such edge yet."""
        self.touched.add(a)
        self.touched.add(b)
        at = -1 if fresh or b not in self.out[a] else self.out[a].index(b)
        if at >= 0:
            self.out_weight[a][at] += weight
            self.into_weight[b][self.into[b].index(a)] += weight
        else:
            at = len(self.out[a])
            self.out[a].append(b)
            self.out_weight[a].append(weight)
            self.out_reads[a].append(0)
            self.into[b].append(a)
            self.into_weight[b].append(weight)
        if read is not None:
            self.out_reads[a][at] |= 1 << read
        self.n_reads[a] += counted
        if keep_weight and read is not None:
            self.read_weight.setdefault(a, {})[read] = weight

    def same_column(self, node: int, base: int) -> int | None:
        return next((x for x in self.column[node] if self.base[x] == base), None)

    def join_column(self, node: int, new: int) -> None:
        for x in self.column[node]:
            self.column[x].append(new)
            self.column[new].append(x)
        self.column[node].append(new)
        self.column[new].append(node)

    # Fusion -----------------------------------------------------------------------------

    def fuse(self, seq, weights, steps: list[tuple[str, int, int]] | None, read: int, begin: int = SOURCE, end: int = SINK, both_ends: bool = True, keep_weight: bool = False) -> list[int]:
        """Adds a read along its alignment; returns the node of each of its letters.

        ``steps``: ("M", node, 1), ("I", -1, letters) and ("D", node, 1). A read
        without steps is left out, unless the graph is empty.
        """
        n = len(seq)
        if n == 0 or (not self.empty and not steps):
            return []
        nodes: list[int] = []
        last, fresh = begin, False

        def go(to: int, is_new: bool, weight: int) -> None:
            nonlocal last, fresh
            inside = last != begin or both_ends
            self.add_edge(last, to, weight, read if inside else None, fresh or is_new, inside, keep_weight)
            if is_new:
                self.n_span[to] = self.n_span[last]
            last, fresh = to, is_new

        if self.empty:
            steps = [("I", -1, n)]
        for op, node, length in steps:
            if op == "M":
                base, weight = int(seq[len(nodes)]), int(weights[len(nodes)])
                if self.base[node] == base:
                    go(node, False, weight)
                elif (other := self.same_column(node, base)) is not None:
                    go(other, False, weight)
                else:
                    new = self.add_node(base)
                    go(new, True, weight)
                    self.join_column(node, new)
                nodes.append(last)
            elif op == "I":
                for _ in range(length):
                    new = self.add_node(int(seq[len(nodes)]))
                    go(new, True, int(weights[len(nodes)]))
                    nodes.append(new)
        self.add_edge(last, end, int(weights[n - 1]), read, fresh, True, keep_weight)
        self.order()
        at, span = self.index, self.n_span
        for x in self.node_at[at[begin] + 1 : at[end]]:
            span[x] += 1
        if both_ends:
            self.n_span[begin] += 1
            self.n_span[end] += 1
        return nodes

    # Orders -----------------------------------------------------------------------------

    def order(self) -> None:
        """Topological order breadth first by columns, edges by weight, and letters left to the sink on the heaviest way.

        Only nodes whose edges changed since the last time can be out of order.
        """
        degree, out, column = list(map(len, self.into)), self.out, self.column
        at = [SOURCE]
        for x in at:  # grows while it is read
            if x == SINK:
                break
            for to in out[x]:
                degree[to] = left = degree[to] - 1
                if left == 0:
                    mates = column[to]
                    if not mates:
                        at.append(to)
                    elif not any([degree[m] for m in mates]):
                        at.append(to)
                        at += mates
        else:
            raise RuntimeError("the graph does not reach its sink")
        del at[at.index(SINK) + 1 :]
        self.node_at = at
        self.index = index = [0] * len(self)
        for i, x in enumerate(at):
            index[x] = i
        for x in self.touched:
            if len(self.into[x]) > 1:
                swap_sorted(self.into_weight[x], self.into[x])
            if len(out[x]) > 1:
                swap_sorted(self.out_weight[x], out[x], self.out_reads[x])
        self.touched.clear()
        self.remain = remain = [0] * len(self)
        remain[SINK] = -1
        for x in at[-2::-1]:
            remain[x] = remain[out[x][0]] + 1
        self.stale = False

    def ranks(self) -> list[int]:
        """Alignment column of each node, depth first: source 0, columns from 1, sink last."""
        rank, n = [-1] * len(self), 0
        degree, stack = list(map(len, self.into)), [SOURCE]
        while stack:
            node = stack.pop()
            if rank[node] < 0:
                for x in (node, *self.column[node]):
                    rank[x] = n
                n += 1
            if node == SINK:
                return rank
            for to in self.out[node]:
                degree[to] -= 1
                if degree[to] == 0 and not any(degree[x] for x in self.column[to]):
                    stack.append(to)
                    stack.extend(self.column[to])
        raise RuntimeError("the graph does not reach its sink")

    # Parts ------------------------------------------------------------------------------

    def region(self, first: int, last: int) -> tuple[int, int]:
        """The two ends of the smallest stretch of the topological order around first to last that edges enter and leave at its ends only.

        Both ends lie outside; the nodes between them are the part. It grows to
        the farthest nodes its edges come from and go to, until it is closed;
        each node is looked at once.
        """
        if self.stale:
            self.order()
        at, nodes = self.index, self.node_at
        low, high = at[first], at[last]  # what has been looked at
        start, stop = low, high
        fresh = range(low, high + 1)
        while fresh:
            inside = [nodes[i] for i in fresh]
            start = min(start, *(at[x] for y in inside for x in self.into[y]), at[SINK])
            stop = max(stop, *(at[x] for y in inside for x in self.out[y]), at[SOURCE])
            fresh = [*range(start + 1, low), *range(high + 1, stop)]
            low, high = min(low, start + 1), max(high, stop - 1)
        return nodes[start], nodes[stop]

    def edges(self):
        """(from, to, weight, reads as bits, place among the edges out, place among the edges in)."""
        for a in range(len(self)):
            for i, b in enumerate(self.out[a]):
                yield a, b, self.out_weight[a][i], self.out_reads[a][i], i, self.into[b].index(a)

    def cells(self) -> list[list[tuple[int, int]]]:
        """For each read its (column from 0, letter code), from the reads on the edges."""
        rank = self.ranks()
        rows: list[list[tuple[int, int]]] = [[] for _ in range(self.n_seq)]
        for node in range(2, len(self)):
            bits = 0
            for x in self.out_reads[node]:
                bits |= x
            while bits:
                low = bits & -bits
                rows[low.bit_length() - 1].append((rank[node] - 1, self.base[node]))
                bits ^= low
        return rows

    def n_columns(self) -> int:
        return self.ranks()[SINK] - 1

    def walk(self) -> list[int]:
        """Breadth first by edges alone; the order of a written graph."""
        degree = [len(x) for x in self.into]
        queue, out = deque([SOURCE]), []
        while queue:
            x = queue.popleft()
            if x == SINK:
                break
            if x != SOURCE:
                out.append(x)
            for y in self.out[x]:
                degree[y] -= 1
                if degree[y] == 0:
                    queue.append(y)
        return out
