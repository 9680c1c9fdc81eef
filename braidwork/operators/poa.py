"""Partial-order alignment of groups of sequences, one graph a group.

The fold over a group's reads is sequential by nature, so a group is one task
and groups run side by side; only the columns a fold needs are shuffled, once,
on the group. What follows the graph is relational and stays in the JVM.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.kernels import jvm, restore
from braidwork.kernels.consensus import Called, call
from braidwork.kernels.fold import fold_many
from braidwork.kernels.lattice import Lattice
from braidwork.kernels.params import Params
from braidwork.plans.columns import take
from braidwork.plans.grouping import each_group, grouped, tables, tasks_for
from braidwork.plans.lineage import written

READS = "array<struct<read_id:int,name:string,is_rc:boolean,score:int>>"
NODES = "array<struct<node_id:int,base:string,n_read:int,n_span_read:int,topo_index:int,walk_index:int,msa_rank:int>>"
EDGES = "array<struct<from_id:int,to_id:int,weight:int,out_ord:int,in_ord:int,read_ids:array<int>>>"
ALIGNED = "array<struct<node_id:int,aligned_id:int,ord:int>>"
ROWS = "array<struct<read_id:int,aligned:string>>"
CONSENSUS = "array<struct<cons_id:int,seq:string,len:int,cov:array<int>,qual:string,node_ids:array<int>,clu_read_ids:array<int>,aligned:string>>"
RESULT = f"group_id string, n_seq int, n_columns int, reads {READS}, nodes {NODES}, edges {EDGES}, aligned {ALIGNED}, msa {ROWS}, consensus {CONSENSUS}"


def _bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


def _arrow_schema() -> pa.Schema:
    i, s, b = pa.int32(), pa.string(), pa.bool_()
    rows = lambda **f: pa.list_(pa.struct(list(f.items())))
    ints = pa.list_(i)
    return pa.schema(
        [
            ("group_id", s), ("n_seq", i), ("n_columns", i),
            ("reads", rows(read_id=i, name=s, is_rc=b, score=i)),
            ("nodes", rows(node_id=i, base=s, n_read=i, n_span_read=i, topo_index=i, walk_index=i, msa_rank=i)),
            ("edges", rows(from_id=i, to_id=i, weight=i, out_ord=i, in_ord=i, read_ids=ints)),
            ("aligned", rows(node_id=i, aligned_id=i, ord=i)),
            ("msa", rows(read_id=i, aligned=s)),
            ("consensus", rows(cons_id=i, seq=s, len=i, cov=ints, qual=s, node_ids=ints, clu_read_ids=ints, aligned=s)),
        ]
    )


SCHEMA = _arrow_schema()
PARTS = ("graph", "msa", "consensus")


def _row(n_columns: int, cells, letters: str) -> str:
    line = ["-"] * n_columns
    for c, b in cells:
        line[c] = letters[b]
    return "".join(line)


def describe(group: str | None, graph: Lattice, params: Params, reads: list[dict], parts: tuple[str, ...]) -> dict:
    """One result row of a graph; a graph without nodes has empty lists."""
    out = {"group_id": group, "n_seq": graph.n_seq, "n_columns": 0, "reads": reads, "nodes": [], "edges": [], "aligned": [], "msa": [], "consensus": []}
    if graph.empty:
        return out
    rank, letters = graph.ranks(), params.letters
    width = out["n_columns"] = rank[1] - 1
    if "graph" in parts:
        walk = {x: i for i, x in enumerate(graph.walk())}
        out["nodes"] = [
            {"node_id": x, "base": letters[graph.base[x]] if x > 1 else None, "n_read": graph.n_reads[x], "n_span_read": graph.n_span[x], "topo_index": graph.index[x], "walk_index": walk.get(x, -1), "msa_rank": rank[x]}
            for x in range(len(graph))
        ]
        out["edges"] = [{"from_id": a, "to_id": b, "weight": w, "out_ord": i, "in_ord": j, "read_ids": _bits(bits)} for a, b, w, bits, i, j in graph.edges()]
        out["aligned"] = [{"node_id": x, "aligned_id": y, "ord": i} for x in range(len(graph)) for i, y in enumerate(graph.column[x])]
    if "msa" in parts:
        out["msa"] = [{"read_id": r, "aligned": _row(width, cells, letters)} for r, cells in enumerate(graph.cells())]
    if "consensus" in parts:
        called: list[Called] = call(graph, params)
        out["consensus"] = [
            {"cons_id": i, "seq": params.decode(c.bases), "len": len(c.bases), "cov": c.cover, "qual": "".join(map(chr, c.quality)), "node_ids": c.nodes, "clu_read_ids": c.reads, "aligned": _row(width, [(rank[x] - 1, graph.base[x]) for x in c.nodes], letters)}
            for i, c in enumerate(called, 1)
        ]
    return out


def _folder(params: Params, parts: tuple[str, ...]):
    def run(batches):
        waiting: deque = deque()

        def reads():
            for name, c in each_group(batches, "group_id"):
                waiting.append((name, c["read_id"], c["name"]))
                yield [(s or "", w or q) for s, q, w in zip(c["seq"], c["qual"], c["weights"])], None

        def rows():
            for done in fold_many(reads(), params):
                name, ids, names = waiting.popleft()
                made = [{"read_id": ids[i], "name": names[i], "is_rc": back, "score": score} for i, back, score in zip(done.order, done.reversed, done.scores)]
                yield describe(name, done.graph, params, made, parts)

        yield from tables(rows(), SCHEMA)

    return run


def checked_weights(weights: str, seq: str) -> Column:
    """The column of weights; an error where they are not one number of at least 0 for each letter."""
    w = F.col(f"`{weights}`").cast("array<int>")
    bad = F.coalesce((F.size(w) > 0) & ((F.size(w) != F.length(F.coalesce(F.col(f"`{seq}`"), F.lit("")))) | F.exists(w, lambda x: x.isNull() | (x < 0))), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("weights must be one number of at least 0 for each letter"))).otherwise(w)


def poa(reads: DataFrame, params: Params = Params(), parts: tuple[str, ...] = PARTS, group: str = "group_id", read_id: str = "read_id", name: str | None = "name", seq: str = "seq", qual: str | None = "qual", weights: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row a group: its reads, graph, alignment and consensus, as far as ``parts`` asks.

    Reads are added in the order of ``read_id``; places in the result count
    from 0 in that order (or by length, with ``longest_first``). ``weights``: a
    column of integers, one a letter, that count in place of qualities; a null
    or empty list leaves the quality, a list of another length and null
    elements are an error. A null or empty sequence is a read that adds nothing; a null
    group is a group; extra columns do not matter; an empty table gives an
    empty result.
    """
    nothing = F.lit(None).cast("string")
    given = F.lit(None).cast("array<int>")
    if weights:
        params = params.with_(use_quality=True)
        given = checked_weights(weights, seq)
    rows = take(reads, group_id=F.col(f"`{group}`").cast("string"), read_id=F.col(f"`{read_id}`").cast("int"), name=F.col(f"`{name}`").cast("string") if name else nothing, seq=seq, qual=(F.col(f"`{qual}`") if qual and params.use_quality else nothing), weights=given)
    if jvm.supported(params) and jvm.available(reads.sparkSession):
        return _compiled(rows, params, parts, partitions, RESULT)
    return grouped(rows, "group_id", "read_id", "seq", "name", partitions=partitions).mapInArrow(_folder(params, parts), RESULT)


#: What ``operators.audit`` counts of each group.
COUNTS = ("n_seq", "letters", "edge_weight", "source_reads", "unbalanced", "backward", "doubled", "ragged", "misspelt", "astray", "light")


def counted(reads: DataFrame, params: Params = Params()) -> DataFrame | None:
    """The audit of each group's graph, counted where it is made; None where the kernel in the JVM does not do these settings.

    ``reads``: group_id, read_id, seq and with ``use_quality`` qual.
    """
    if params.amino or not jvm.supported(params) or not jvm.available(reads.sparkSession):
        return None
    none = lambda t: F.lit(None).cast(t)
    rows = take(reads, group_id=F.col("group_id").cast("string"), read_id=F.col("read_id").cast("int"), name=none("string"), seq="seq", qual=F.col("qual") if params.use_quality else none("string"), weights=none("array<int>"))
    return _compiled(rows, params, ("audit",), None, ", ".join(f"{c} bigint" for c in COUNTS))


GRAPH_LINES = "lines array<string>, paths array<struct<read:int,line:string>>"


def graph_lines(reads: DataFrame, params: Params = Params(), with_consensus: bool = False) -> DataFrame:
    """(group_id, lines, paths): the lines of ``gfa_lines`` of each group's graph in their order, made where the graph is.

    ``paths``: (read, line) of the P lines, no read for the consensus;
    ``lines``: all others. A group without letters has none, or no row.
    ``reads``: group_id, read_id, name, seq and with ``use_quality`` qual.
    """
    if jvm.supported(params) and jvm.available(reads.sparkSession):
        rows = take(reads, group_id=F.col("group_id").cast("string"), read_id=F.col("read_id").cast("int"), name=F.col("name").cast("string"), seq="seq", qual=F.col("qual") if params.use_quality else F.lit(None).cast("string"), weights=F.lit(None).cast("array<int>"))
        return _compiled(rows, params, ("lines", "consensus") if with_consensus else ("lines",), None, GRAPH_LINES)
    result = written(poa(reads, params, ("graph", "consensus") if with_consensus else ("graph",)), "graphs")  # read for each kind of line
    every = gfa_lines(result, with_consensus).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("section", "ord", "line"))).alias("x"))
    paths = F.transform(F.filter("x", lambda x: x.section > 1), lambda x: F.struct(F.when(x.section == 2, x.ord.cast("int")).alias("read"), x.line.alias("line")))
    return every.select("group_id", F.transform(F.filter("x", lambda x: x.section < 2), lambda x: x.line).alias("lines"), paths.alias("paths"))


def _compiled(rows: DataFrame, params: Params, parts: tuple[str, ...], partitions: int | None, result: str) -> DataFrame:
    """As ``_folder`` on sorted groups, by the kernel in the JVM."""
    groups = rows.repartition(partitions or tasks_for(rows), "group_id").groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("read_id", "seq", "name", "qual", "weights"))).alias("x"))
    made = groups.select("group_id", jvm.call(rows, result.removeprefix("group_id string, "), "x", F.lit(jvm.settings(params, parts))).alias("x"))
    return made.select("group_id", "x.*")


def _restorer(build, params: Params, parts: tuple[str, ...]):
    """``build``: from a group's columns to (restored graph, ids of its reads)."""

    def run(batches):
        def rows():
            for name, c in each_group(batches, "group_id"):
                got, ids = build(c)
                made = [{"read_id": r, "name": n or None, "is_rc": b, "score": 0} for r, n, b in zip(ids, got.names, got.reversed)]
                yield describe(name, got.graph, params, made, parts)

        yield from tables(rows(), SCHEMA)

    return run


def restored_rows(c: dict[str, list], params: Params) -> tuple[restore.Restored, list[int]]:
    return restore.from_rows([(n or "", a) for n, a in zip(c["name"], c["aligned"])], params), c["read_id"]


def restored_paths(c: dict[str, list], params: Params) -> tuple[restore.Restored, list[int]]:
    fields = [x.split("\t") for x in c["line"]]
    got = restore.from_paths([(f[1], f[2]) for f in fields if f[0] == "S"], [(f[1], f[2]) for f in fields if f[0] == "P"], params)
    return got, list(range(len(got.names)))


def aligned_input(rows: DataFrame, group: str, read_id: str, name: str | None, aligned: str) -> DataFrame:
    take_name = F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")
    kept = take(rows, group_id=F.col(f"`{group}`").cast("string"), read_id=F.col(f"`{read_id}`").cast("int"), name=take_name, aligned=aligned).where("aligned is not null")
    return grouped(kept, "group_id", "read_id", "aligned")


def gfa_input(lines: DataFrame, group: str, order: str, line: str) -> DataFrame:
    kept = take(lines, group_id=F.col(f"`{group}`").cast("string"), line_no=F.col(f"`{order}`").cast("long"), line=line)
    return grouped(kept.where(F.col("line").startswith("S\t") | F.col("line").startswith("P\t")), "group_id", "line_no", "line")


def from_aligned(rows: DataFrame, params: Params = Params(), parts: tuple[str, ...] = PARTS, group: str = "group_id", read_id: str = "read_id", name: str | None = None, aligned: str = "aligned") -> DataFrame:
    """Graphs restored from aligned rows; a null row is left out."""
    return aligned_input(rows, group, read_id, name, aligned).mapInArrow(_restorer(lambda c: restored_rows(c, params), params, parts), RESULT)


def from_gfa(lines: DataFrame, params: Params = Params(), parts: tuple[str, ...] = PARTS, group: str = "group_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Graphs restored from S and P lines; other lines do not matter."""
    return gfa_input(lines, group, order, line).mapInArrow(_restorer(lambda c: restored_paths(c, params), params, parts), RESULT)


# Tables of a result ------------------------------------------------------------------------


def part(result: DataFrame, name: str) -> DataFrame:
    """One of the lists as rows: ``reads``, ``nodes``, ``edges``, ``aligned``, ``msa`` or ``consensus``."""
    return result.select("group_id", F.explode(name).alias("x")).select("group_id", "x.*")


def cells(result: DataFrame) -> DataFrame:
    """(group_id, read_id, col, base) of every aligned letter, gaps left out."""
    rows = part(result, "msa")
    return rows.select("group_id", "read_id", F.posexplode(F.split("aligned", "")).alias("col", "base")).where("base <> '-' and base <> ''")


def read_paths(result: DataFrame) -> DataFrame:
    """(group_id, read, node_ids) of the nodes each read takes, from the reads on the edges."""
    steps = part(result, "edges").where("from_id > 1").select("group_id", F.col("from_id").alias("node_id"), F.explode("read_ids").alias("read"))
    at = part(result, "nodes").select("group_id", "node_id", "walk_index")
    ordered = steps.join(at, ["group_id", "node_id"]).groupBy("group_id", "read").agg(F.sort_array(F.collect_list(F.struct("walk_index", "node_id"))).alias("x"))
    return ordered.select("group_id", "read", F.transform("x", lambda s: s.node_id).alias("node_ids"))


def _head(batch: str | None) -> Column:
    number = F.concat(F.lit("_"), F.col(batch).cast("string")) if batch else F.lit("")
    some = F.concat(F.lit("_"), F.col("cons_id").cast("string"), F.lit(" "), F.array_join(F.transform("clu_read_ids", lambda r: r.cast("string")), ","))
    return F.concat(F.lit("Consensus_sequence"), number, F.when(F.col("n_cons") > 1, some).otherwise(F.lit("")))


def consensus_lines(result: DataFrame, quality: bool = False, batch: str | None = None) -> DataFrame:
    """(group_id, ord, line) of FASTA or FASTQ records. ``batch``: a column of the result that numbers the groups."""
    kept = ["group_id", *([batch] if batch else [])]
    rows = result.select(*kept, F.size("consensus").alias("n_cons"), F.explode("consensus").alias("x")).select(*kept, "n_cons", "x.*")
    head = _head(batch)
    record = [F.concat(F.lit("@"), head), F.col("seq"), F.concat(F.lit("+"), head), F.col("qual")] if quality else [F.concat(F.lit(">"), head), F.col("seq")]
    lines = rows.select("group_id", "cons_id", F.posexplode(F.array(*record)).alias("i", "line"))
    return lines.select("group_id", (F.col("cons_id") * len(record) + F.col("i")).alias("ord"), "line")


def msa_lines(result: DataFrame, with_consensus: bool = True) -> DataFrame:
    """(group_id, ord, line) of the aligned rows as FASTA."""
    names = result.select("group_id", F.posexplode("reads").alias("read_id", "x")).select("group_id", "read_id", "x.name", "x.is_rc")
    label = F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.concat("name", F.when(F.col("is_rc"), F.lit("_reverse_complement")).otherwise(F.lit("")))).otherwise(F.concat(F.lit("Seq_"), (F.col("read_id") + 1).cast("string")))
    reads = part(result, "msa").join(names, ["group_id", "read_id"]).select("group_id", F.col("read_id").alias("at"), F.array(F.concat(F.lit(">"), label), F.col("aligned")).alias("x"))
    if with_consensus:
        rows = result.select("group_id", "n_seq", F.size("consensus").alias("n_cons"), F.explode("consensus").alias("c")).select("group_id", "n_seq", "n_cons", "c.*")
        reads = reads.unionByName(rows.select("group_id", (F.col("n_seq") + F.col("cons_id")).alias("at"), F.array(F.concat(F.lit(">"), _head(None)), F.col("aligned")).alias("x")))
    lines = reads.select("group_id", "at", F.posexplode("x").alias("i", "line"))
    return lines.select("group_id", (F.col("at") * 2 + F.col("i")).cast("int").alias("ord"), "line")


def gfa_lines(result: DataFrame, with_consensus: bool = False) -> DataFrame:
    """(group_id, section, ord, line): H, then S with their L lines, then P lines; node n is segment n - 1."""
    alive = result.where(F.size("nodes") > 2)
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    links = F.size(F.filter("edges", lambda e: (e.from_id != 0) & (e.to_id != 1)))
    head = alive.select("group_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("H\tVN:Z:1.0\tNS:i:"), (F.size("nodes") - 2).cast("string"), F.lit("\tNL:i:"), links.cast("string"), F.lit("\tNP:i:"), (F.col("n_seq") + int(with_consensus)).cast("string")).alias("line"))
    nodes = part(alive, "nodes").where("walk_index >= 0")
    wide = F.lit(1 << 20).cast("long")
    segments = nodes.select("group_id", F.lit(1).alias("section"), (F.col("walk_index") * wide).alias("ord"), F.concat(F.lit("S\t"), text(F.col("node_id") - 1), F.lit("\t"), F.col("base")).alias("line"))
    edges = part(alive, "edges").where("from_id <> 0 and to_id <> 1").join(nodes.select("group_id", F.col("node_id").alias("to_id"), "walk_index"), ["group_id", "to_id"])
    joins = edges.select("group_id", F.lit(1).alias("section"), (F.col("walk_index") * wide + F.col("in_ord") + 1).alias("ord"), F.concat(F.lit("L\t"), text(F.col("from_id") - 1), F.lit("\t+\t"), text(F.col("to_id") - 1), F.lit("\t+\t0M")).alias("line"))
    who = alive.select("group_id", F.posexplode("reads").alias("read", "x")).select("group_id", "read", "x.name", "x.is_rc")
    nth = lambda sign: lambda x: F.concat((x - 1).cast("string"), F.lit(sign))
    way = F.when(F.col("is_rc"), F.array_join(F.transform(F.reverse("node_ids"), nth("-")), ",")).otherwise(F.array_join(F.transform("node_ids", nth("+")), ","))
    label = F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.col("name")).otherwise((F.col("read") + 1).cast("string"))
    paths = read_paths(alive).join(who, ["group_id", "read"]).select("group_id", F.lit(2).alias("section"), F.col("read").cast("long").alias("ord"), F.concat(F.lit("P\t"), label, F.lit("\t"), way, F.lit("\t*")).alias("line"))
    out = head.unionByName(segments).unionByName(joins).unionByName(paths)
    if with_consensus:
        rows = alive.select("group_id", F.size("consensus").alias("n_cons"), F.explode("consensus").alias("c")).select("group_id", "n_cons", "c.*")
        cons = rows.select("group_id", F.lit(3).alias("section"), F.col("cons_id").cast("long").alias("ord"), F.concat(F.lit("P\tConsensus_sequence"), F.when(F.col("n_cons") > 1, F.concat(F.lit("_"), text("cons_id"))).otherwise(F.lit("")), F.lit("\t"), F.array_join(F.transform("node_ids", nth("+")), ","), F.lit("\t*")).alias("line"))
        out = out.unionByName(cons)
    return out


#: Node colours of A, C, G, T and N, and of all else.
COLOURS = {"A": "pink1", "C": "red1", "G": "gold2", "T": "seagreen4"}


def dot_lines(result: DataFrame) -> DataFrame:
    """(group_id, section, ord, line) of a drawing of the graph for Graphviz, to be rendered outside."""
    nodes = part(result.where(F.size("nodes") > 2), "nodes")
    label = lambda base, at: F.concat(F.lit('"'), base, F.lit("\\n"), at.cast("string"), F.lit('"'))
    nodes = nodes.withColumn("base", F.when(F.col("node_id") == 0, "S").when(F.col("node_id") == 1, "E").otherwise(F.col("base")))
    nodes = nodes.withColumn("label", label(F.col("base"), F.col("topo_index")))
    colour = F.lit("gray")
    for letter, value in COLOURS.items():
        colour = F.when((F.col("base") == letter) & (F.col("node_id") > 1), value).otherwise(colour)
    groups = nodes.groupBy("group_id").agg(F.count("*").alias("n"))
    head = groups.select("group_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("// graph of reads, "), F.col("n").cast("string"), F.lit(" nodes")).alias("line"))
    head = head.unionByName(groups.select("group_id", F.lit(0).alias("section"), F.lit(1).cast("long").alias("ord"), F.lit('digraph graph_of_reads {\n\tgraph [rankdir="LR"];\n\tnode [width=1, style=filled, fixedsize=true, fontsize=24, shape=circle];\n\tedge [fontsize=20];').alias("line")))
    dots = nodes.select("group_id", F.lit(1).alias("section"), F.col("topo_index").cast("long").alias("ord"), F.concat("label", F.lit(" [color="), colour, F.lit("]")).alias("line"))
    ends = nodes.select("group_id", "node_id", "label", "topo_index")
    a, b = (ends.select("group_id", F.col("node_id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label"), F.col("topo_index").alias(f"{s}_at")) for s in ("from", "to"))
    arrows = part(result, "edges").join(a, ["group_id", "from_id"]).join(b, ["group_id", "to_id"])
    arrows = arrows.select("group_id", F.lit(2).alias("section"), (F.col("from_at").cast("long") * (1 << 20) + F.col("out_ord")).alias("ord"), F.concat(F.lit("\t"), "from_label", F.lit(" -> "), "to_label", F.lit(' [label="'), F.col("weight").cast("string"), F.lit('", penwidth='), (F.col("weight") + 1).cast("string"), F.lit("]")).alias("line"))
    # one set for each column with more than one node, named by all of them
    mates = part(result, "aligned").select("group_id", F.col("node_id").alias("from_id"), F.col("aligned_id").alias("to_id"))
    mates = mates.join(a, ["group_id", "from_id"]).join(b, ["group_id", "to_id"]).groupBy("group_id", "from_id", "from_at", "from_label").agg(F.sort_array(F.collect_list(F.struct("to_at", "to_label"))).alias("x"))
    chained = F.concat(F.lit("\t{rank=same; "), F.array_join(F.concat(F.array("from_label"), F.transform("x", lambda m: m.to_label)), " -> "), F.lit(" [style=dashed, arrowhead=none]}"))
    columns = mates.where(F.col("from_at") < F.col("x")[0].to_at).select("group_id", F.lit(3).alias("section"), F.col("from_at").cast("long").alias("ord"), chained.alias("line"))
    foot = groups.select("group_id", F.lit(4).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit("}").alias("line"))
    return head.unionByName(dots).unionByName(arrows).unionByName(columns).unionByName(foot)


#: The numbered modes of output, with the parts of a result each needs.
MODES = {0: ("consensus",), 1: ("msa",), 2: ("msa", "consensus"), 3: ("graph",), 4: ("graph", "consensus"), 5: ("consensus",)}


def lines(result: DataFrame, mode: int) -> DataFrame:
    """Lines of a mode: 0 consensus as FASTA, 1 aligned rows, 2 both, 3 the graph, 4 the graph with consensus paths, 5 consensus as FASTQ."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    if mode in (0, 5):
        return consensus_lines(result, quality=mode == 5)
    return msa_lines(result, with_consensus=mode == 2) if mode in (1, 2) else gfa_lines(result, with_consensus=mode == 4)


def write_lines(lines: DataFrame, path: str) -> None:
    """One file a group, lines in their order; ``lines`` has group_id, line and one or two columns of order."""
    order = [c for c in ("section", "ord") if c in lines.columns]
    lines.repartition("group_id").sortWithinPartitions("group_id", *order).select("group_id", "line").write.partitionBy("group_id").text(path)
