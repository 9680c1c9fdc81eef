"""Reads that arrive later, added to graphs that are kept: in batches, and in a stream.

A graph's state is one compact binary value a group. Batches join state and
new reads on the group; the stream keeps the state in Structured Streaming's
store. Either way reads are added in the order (batch, read_id), so a stream
and the same batches give the same graphs.
"""

from __future__ import annotations

import pickle
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from braidwork.kernels import jvm
from braidwork.kernels.fold import fold_many
from braidwork.kernels.lattice import Lattice
from braidwork.kernels.params import Params
from braidwork.operators import poa
from braidwork.operators.poa import RESULT, SCHEMA, checked_weights, describe
from braidwork.plans.columns import take
from braidwork.plans.grouping import each_group, grouped, tables, tasks_for

STATE = "group_id string, n_seq int, state binary"


_MARK = b"BW1\n"


def pack(graph: Lattice, reads: list[dict]) -> bytes:
    """Whole numbers only, list after list, and the reads' names, compressed; ``kernels/Fold.java`` reads and writes the same."""
    flat = lambda x: [v for part in x for v in part]
    size = lambda x: list(map(len, x))
    on = [poa._bits(x) for x in flat(graph.out_reads)]
    kept = [v for a, of in graph.read_weight.items() for read, w in of.items() for v in (a, read, w)]
    names = [None if r["name"] is None else r["name"].encode() for r in reads]
    parts = [
        [len(graph), graph.n_seq, len(on), sum(map(len, on)), sum(map(len, graph.column)), len(kept) // 3, len(reads)],
        graph.base, graph.n_reads, graph.n_span, size(graph.into), flat(graph.into), flat(graph.into_weight), size(graph.out), flat(graph.out), flat(graph.out_weight),
        size(on), flat(on), size(graph.column), flat(graph.column), kept,
        [r["read_id"] or 0 for r in reads], [r["read_id"] is None for r in reads], [r["is_rc"] for r in reads], [r["score"] for r in reads], [-1 if x is None else len(x) for x in names],
    ]
    return zlib.compress(b"".join([_MARK, *(np.array(x, "<i4").tobytes() for x in parts), *(x for x in names if x)]), 1)


def unpack(state: bytes | None) -> tuple[Lattice, list[dict]]:
    graph = Lattice()
    if state is None:
        return graph, []
    raw = zlib.decompress(state)
    if raw[:4] != _MARK:  # states of earlier versions
        kept, reads = pickle.loads(raw)
        for k, v in kept.items():
            setattr(graph, k, v)
    else:
        reads = _read(raw, graph)
    if not graph.empty:
        graph.order()
    return graph, reads


def _read(raw: bytes, graph: Lattice) -> list[dict]:
    at = 4

    def ints(n: int) -> list[int]:
        nonlocal at
        at += 4 * n
        return np.frombuffer(raw, "<i4", n, at - 4 * n).tolist()

    def parts(sizes: list[int], flat: list[int]) -> list[list[int]]:
        items = iter(flat)
        return [list(islice(items, n)) for n in sizes]

    n, graph.n_seq, n_edges, n_on, n_mates, n_kept, n_reads = ints(7)
    graph.base, graph.n_reads, graph.n_span = ints(n), ints(n), ints(n)
    into = ints(n)
    graph.into, graph.into_weight = parts(into, ints(n_edges)), parts(into, ints(n_edges))
    out = ints(n)
    graph.out, graph.out_weight = parts(out, ints(n_edges)), parts(out, ints(n_edges))
    on = ints(n_edges)
    graph.out_reads = parts(out, [sum(1 << r for r in x) for x in parts(on, ints(n_on))])
    mates = ints(n)
    graph.column = parts(mates, ints(n_mates))
    graph.touched.clear()
    for a, read, w in parts([3] * n_kept, ints(3 * n_kept)):
        graph.read_weight.setdefault(a, {})[read] = w
    ids, none, back, score, length = (ints(n_reads) for _ in range(5))
    reads = []
    for i in range(n_reads):
        stop = at + max(0, length[i])
        reads.append({"read_id": None if none[i] else ids[i], "name": None if length[i] < 0 else raw[at:stop].decode(), "is_rc": bool(back[i]), "score": score[i]})
        at = stop
    return reads


def _grow(states: Iterable[tuple[bytes | None, dict[str, list]]], params: Params) -> Iterator[tuple[Lattice, list[dict]]]:
    """Each group's graph and reads after its new reads, which come in their order."""
    held: deque = deque()

    def groups():
        for state, c in states:
            graph, reads = unpack(state)
            held.append((c, reads))
            rows = [(s or "", w or q) for s, q, w in zip(c["seq"], c["qual"], c["weights"])]
            spans = [None if a is None or b is None else (a, b) for a, b in zip(c["first_node"], c["last_node"])]
            yield (rows, graph, spans) if any(spans) else (rows, graph)

    for done in fold_many(groups(), params):
        c, reads = held.popleft()
        reads += [{"read_id": c["read_id"][i], "name": c["name"][i], "is_rc": b, "score": s} for i, b, s in zip(done.order, done.reversed, done.scores)]
        yield done.graph, reads


def _reads(df: DataFrame, weights: str | None = None, nodes: tuple[str, str] | None = None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    first, last = (F.col(f"`{n}`").cast("int") for n in nodes) if nodes else (none("int"), none("int"))
    return take(
        df, group_id=F.col("group_id").cast("string"), read_id=F.col("read_id").cast("int"), name="name", seq="seq", qual="qual",
        weights=checked_weights(weights, "seq") if weights else none("array<int>"), first_node=first, last_node=last,
    )


_STATE = pa.schema([("group_id", pa.string()), ("n_seq", pa.int32()), ("state", pa.binary())])
_COLUMNS = ("read_id", "name", "seq", "qual", "weights", "first_node", "last_node")


def add(state: DataFrame | None, reads: DataFrame, params: Params = Params(), partitions: int | None = None, weights: str | None = None, nodes: tuple[str, str] | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, n_seq, state) after the reads; groups without new reads stay as they are.

    ``state``: of ``add``, ``from_gfa`` or ``from_aligned``. ``weights``: as in
    ``poa``. ``nodes``: columns with the first and last node a read belongs to; it
    is aligned to the closed part of the graph around them only. Reads without
    both go to the whole graph. With ``parts``, what ``finish`` makes of the state, which is not kept then.
    """
    params = params.with_(use_quality=True) if weights else params

    def run(batches):
        names: deque = deque()

        def states():
            for name, c in each_group(batches, "group_id"):
                names.append(name)
                new = [i for i, x in enumerate(c["is_new"]) if x]
                yield next((x for x in c["state"] if x is not None), None), {k: [c[k][i] for i in new] for k in _COLUMNS}

        done = ((names.popleft(), graph, kept) for graph, kept in _grow(states(), params))
        yield from tables(({"group_id": n, "n_seq": g.n_seq, "state": pack(g, r)} for n, g, r in done), _STATE)

    rows = _reads(reads if params.use_quality else reads.withColumn("qual", F.lit(None).cast("string")), weights, nodes).withColumns({"state": F.lit(None).cast("binary"), "is_new": F.lit(True)})
    if state is not None:
        none = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c in _COLUMNS}
        rows = rows.unionByName(state.select("group_id", *[v.alias(k) for k, v in none.items()], "state", F.lit(False).alias("is_new")))
    if nodes is None and jvm.supported(params) and jvm.available(reads.sparkSession):
        new = F.when(F.col("is_new"), F.struct("read_id", "seq", "name", "qual", "weights"))
        groups = rows.repartition(partitions or tasks_for(rows), "group_id").groupBy("group_id").agg(F.first("state", ignorenulls=True).alias("state"), F.sort_array(F.collect_list(new)).alias("x"))
        return _kernel(groups, "Grow", F.struct("state", "x"), params, parts, RESULT if parts else STATE)
    grown = grouped(rows, "group_id", "is_new", "read_id", "seq", "name", partitions=partitions).mapInArrow(run, STATE)
    return finish(grown, params, parts) if parts else grown


def _kernel(groups: DataFrame, name: str, of: Column, params: Params, parts: tuple[str, ...] = (), result: str = STATE) -> DataFrame:
    """States or results made by a kernel in the JVM."""
    made = jvm.call(groups, result.removeprefix("group_id string, "), of, F.lit(jvm.settings(params, parts)), kernel=f"Fold${name}")
    return groups.select("group_id", made.alias("x")).select("group_id", "x.*")


def _restored(df: DataFrame, build, params: Params) -> DataFrame:
    def run(batches):
        def rows():
            for name, c in each_group(batches, "group_id"):
                got, ids = build(c, params)
                reads = [{"read_id": r, "name": n or None, "is_rc": b, "score": 0} for r, n, b in zip(ids, got.names, got.reversed)]
                yield {"group_id": name, "n_seq": got.graph.n_seq, "state": pack(got.graph, reads)}

        yield from tables(rows(), _STATE)

    return df.mapInArrow(run, STATE)


def from_aligned(rows: DataFrame, params: Params = Params(), group: str = "group_id", read_id: str = "read_id", name: str | None = None, aligned: str = "aligned") -> DataFrame:
    """States of graphs restored from aligned rows, to which ``add`` adds reads."""
    return _restored(poa.aligned_input(rows, group, read_id, name, aligned), poa.restored_rows, params)


def from_gfa(lines: DataFrame, params: Params = Params(), group: str = "group_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """States of graphs restored from S and P lines, to which ``add`` adds reads."""
    return _restored(poa.gfa_input(lines, group, order, line), poa.restored_paths, params)


def from_graph_lines(graphs: DataFrame, params: Params = Params()) -> DataFrame:
    """As ``from_gfa``, of graphs that have their lines in one row: (group_id, lines, paths) as ``poa.graph_lines`` gives them."""
    known = graphs.where(F.size("lines") > 0)
    if jvm.available(graphs.sparkSession):
        return _kernel(known, "Restore", F.struct("lines", F.col("paths.line").alias("paths")), params)
    return from_gfa(known.select("group_id", F.posexplode(F.concat("lines", "paths.line")).alias("line_no", "line")), params)


def finish(state: DataFrame, params: Params = Params(), parts: tuple[str, ...] = ("graph", "msa", "consensus")) -> DataFrame:
    """One result row a group, as the batch operator gives it."""

    def batches(it):
        for batch in it:
            rows = []
            for name, blob in zip(batch.column("group_id").to_pylist(), batch.column("state").to_pylist()):
                graph, reads = unpack(blob)
                rows.append(describe(name, graph, params, reads, parts))
            yield from pa.Table.from_pylist(rows, schema=SCHEMA).to_batches()

    if jvm.supported(params) and jvm.available(state.sparkSession):
        return _kernel(state, "Finish", F.col("state"), params, parts, RESULT)
    return state.select("group_id", "state").mapInArrow(batches, RESULT)


CALLED = "group_id string, n_seq int, cons_id int, seq string, qual string"


def consensus_stream(reads: DataFrame, params: Params = Params()) -> DataFrame:
    """A stream of each group's consensus after each batch that brought it reads, in update mode."""
    from braidwork.kernels.consensus import call

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((dict.fromkeys(_COLUMNS) | r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")), key=lambda r: (r["read_id"] is not None, r["read_id"] or 0))
        graph, kept = next(_grow([(bytes(state.get[0]) if state.exists else None, {k: [r[k] for r in rows] for k in _COLUMNS})], params))
        state.update((pack(graph, kept),))
        yield pd.DataFrame([(key[0], graph.n_seq, i, params.decode(c.bases), "".join(map(chr, c.quality))) for i, c in enumerate(call(graph, params), 1)], columns=["group_id", "n_seq", "cons_id", "seq", "qual"])

    return _reads(reads).drop("weights", "first_node", "last_node").groupBy("group_id").applyInPandasWithState(update, CALLED, "state binary", "update", GroupStateTimeout.NoTimeout)
