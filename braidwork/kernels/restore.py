"""Graphs from what was written of them: segments with paths, or aligned rows."""

from __future__ import annotations

from dataclasses import dataclass

from braidwork.kernels.lattice import SINK, SOURCE, Lattice
from braidwork.kernels.params import Params


@dataclass
class Restored:
    graph: Lattice
    names: list[str]
    reversed: list[bool]


def from_paths(segments: list[tuple[str, str]], paths: list[tuple[str, str]], params: Params) -> Restored:
    """``segments``: (name, sequence), ``paths``: (name, ``a+,b+`` or ``b-,a-``).

    A segment becomes nodes where a path first uses it; each path adds 1 to
    each edge it takes. A name that comes twice, a path to an unknown segment
    and a path of both directions are errors. A consensus path is a read like
    any other.
    """
    text: dict[str, str] = {}
    for name, seq in segments:
        if name in text:
            raise ValueError(f"segment {name!r} comes twice")
        text[name] = seq
    graph, nodes = Lattice(), {}
    out = Restored(graph, [], [])
    for read, (name, path) in enumerate(paths):
        parts = [x for x in path.split(",") if x]
        if not parts:
            raise ValueError(f"path {name!r} is empty")
        signs = {x[-1] for x in parts}
        if signs not in ({"+"}, {"-"}):
            raise ValueError(f"path {name!r} has segments of both directions, or of none")
        back = signs == {"-"}
        walk: list[int] = []
        for x in (p[:-1] for p in parts):
            if x not in text:
                raise ValueError(f"path {name!r} names an unknown segment {x!r}")
            if x not in nodes:
                nodes[x] = [graph.add_node(int(b)) for b in params.encode(text[x])]
            walk = nodes[x] + walk if back else walk + nodes[x]
        for a, b in zip([SOURCE, *walk], [*walk, SINK]):
            graph.add_edge(a, b, 1, read)
        out.names.append(name)
        out.reversed.append(back)
    graph.n_seq = len(paths)
    return _ready(out)


def from_rows(rows: list[tuple[str, str]], params: Params) -> Restored:
    """``rows``: (name, aligned sequence with ``-`` for gaps); a column holds one node for each of its letters."""
    graph = Lattice()
    out = Restored(graph, [], [])
    first: dict[int, int] = {}
    for read, (name, row) in enumerate(rows):
        last = SOURCE
        codes = params.encode(row)
        for column, letter in enumerate(row):
            if letter == "-":
                continue
            base = int(codes[column])
            if column not in first:
                node = first[column] = graph.add_node(base)
            elif graph.base[first[column]] == base:
                node = first[column]
            else:
                node = graph.same_column(first[column], base)
                if node is None:
                    node = graph.add_node(base)
                    graph.join_column(first[column], node)
            graph.add_edge(last, node, 1, read)
            last = node
        graph.add_edge(last, SINK, 1, read)
        back = name.endswith("_reverse_complement")
        out.names.append(name.removesuffix("_reverse_complement"))
        out.reversed.append(back)
    graph.n_seq = len(rows)
    return _ready(out)


def _ready(out: Restored) -> Restored:
    if not out.graph.empty:
        out.graph.order()
        out.graph.n_span = [out.graph.n_seq] * len(out.graph)
    return out
