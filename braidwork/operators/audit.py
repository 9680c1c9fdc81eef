"""What must hold of every graph, counted: a result that is sound has only zeros behind its totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import sequences as S
from braidwork.operators.poa import part
from braidwork.plans.columns import take


def audit(result: DataFrame, reads: DataFrame) -> DataFrame:
    """One row a group: totals, and how often something does not hold.

    ``result`` has all parts and is read several times, so it should be a
    written table; ``reads`` (group_id, read_id, seq) are those it was made of.

    n_seq, letters (of the aligned rows), edge_weight, source_reads: totals.
    unbalanced: nodes that not as many reads enter as leave. backward: edges
    against the topological order or within a column. doubled: columns with a
    letter twice. ragged: rows of another length than the alignment. misspelt:
    rows that without gaps are not their read (its reverse complement, if it was
    turned). astray: steps of a consensus without an edge. light: steps of a
    heaviest consensus along an edge that is not its node's heaviest. Empty groups have zeros.
    """
    groups = take(result, group_id="group_id", n_seq=F.col("n_seq").cast("long"))
    edges, nodes = part(result, "edges"), part(result, "nodes")
    of = lambda side: edges.groupBy("group_id", F.col(f"{side}_id").alias("node_id")).agg(F.sum(F.size("read_ids")).alias("n"))
    flow = of("from").withColumn("sign", F.lit(1)).unionByName(of("to").withColumn("sign", F.lit(-1))).where("node_id > 1")
    flow = flow.groupBy("group_id", "node_id").agg(F.sum(F.col("n") * F.col("sign")).alias("x")).where("x <> 0").groupBy("group_id").agg(F.count("*").alias("unbalanced"))
    weights = edges.groupBy("group_id").agg(F.sum("weight").alias("edge_weight"), F.sum(F.when(F.col("from_id") == 0, F.size("read_ids"))).cast("long").alias("source_reads"))
    at = nodes.select("group_id", "node_id", "topo_index", "msa_rank")
    a, b = (at.select("group_id", F.col("node_id").alias(f"{x}_id"), F.col("topo_index").alias(f"{x}_at"), F.col("msa_rank").alias(f"{x}_rank")) for x in ("from", "to"))
    backward = edges.join(a, ["group_id", "from_id"]).join(b, ["group_id", "to_id"]).where("from_at >= to_at or from_rank >= to_rank").groupBy("group_id").agg(F.count("*").alias("backward"))
    doubled = nodes.where("node_id > 1").groupBy("group_id", "msa_rank", "base").count().where("count > 1").groupBy("group_id").agg(F.count("*").alias("doubled"))
    who = result.select("group_id", F.posexplode("reads").alias("row", "x")).select("group_id", "row", "x.read_id", "x.is_rc")
    rows = result.select("group_id", "n_columns", F.explode("msa").alias("m")).select("group_id", "n_columns", F.col("m.read_id").alias("row"), F.col("m.aligned").alias("aligned"))
    own = reads.select(F.col("group_id"), "read_id", S.residues("seq").alias("s"))
    rows = rows.join(who, ["group_id", "row"], "left").join(own, ["group_id", "read_id"], "left").withColumn("letters", F.regexp_replace("aligned", "-", ""))
    wanted = F.when(F.col("is_rc"), F.reverse(F.translate("s", "ACGT", "TGCA"))).otherwise(F.col("s"))
    rows = rows.groupBy("group_id").agg(F.sum(F.length("letters")).alias("letters"), F.count_if(F.length("aligned") != F.col("n_columns")).alias("ragged"), F.count_if(~F.col("letters").eqNullSafe(wanted)).alias("misspelt"))
    steps = part(result, "consensus").where(F.size("clu_read_ids") > 0).select("group_id", "cons_id", F.posexplode("node_ids").alias("i", "from_id"), "node_ids")
    steps = steps.select("group_id", "cons_id", "from_id", F.coalesce(F.get("node_ids", F.col("i") + 1), F.lit(1)).alias("to_id"))
    best = edges.groupBy("group_id", "from_id").agg(F.max("weight").alias("best"))
    taken = steps.join(edges.select("group_id", "from_id", "to_id", "weight"), ["group_id", "from_id", "to_id"], "left").join(best, ["group_id", "from_id"], "left")
    taken = taken.groupBy("group_id").agg(F.count_if(F.col("weight").isNull()).alias("astray"), F.count_if(F.col("weight") < F.col("best")).alias("light"))
    out = groups
    for x in (weights, flow, backward, doubled, rows, taken):
        out = out.join(x, "group_id", "left")
    return out.select("group_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_seq", "letters", "edge_weight", "source_reads", "unbalanced", "backward", "doubled", "ragged", "misspelt", "astray", "light")])
