"""The registered queries over the test tables, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork import catalog_sql
from braidwork.functions import sequences as S
from braidwork.kernels.params import Params
from braidwork.operators import columns, reject, sketch
from braidwork.plans.lineage import scratch
from braidwork.sources import fastx, gfa

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Of rows delivered more than once the first; rows without a sequence are left out."""
    rows = _table(spark, sf, "seq_reads").where("seq is not null and seq <> ''")
    kept = rows.groupBy("group_id", "read_id").agg(F.min_by(F.struct("name", "seq", "qual"), "read_key").alias("x"))
    return kept.select("group_id", "read_id", "x.*")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return columns.padded(reads(spark, sf))


# Lines of files ------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return reject.parse_lines(_table(spark, sf, "raw_records"), "raw_id", "source_file", "line_no", "rec_format", "raw_line")


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return reject.rejected(_parsed(spark, sf)).select(F.col("key").alias("raw_id"), "reason")


@query
def p4_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reject.accepted(_parsed(spark, sf)).select(F.col("key").alias("raw_id"), "kind", "read_id", "name", "comment", "seq", "qual", F.array_join("tags", "\t").alias("tags"))


@query
def fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each read written as a record and read again."""
    text = reads(spark, sf).select("group_id", F.concat(F.lit(">"), "name", F.lit(" x\n"), "seq").alias("text"))
    return fastx.parse_fasta(text, "text", "group_id").select("group_id", "name", "seq")


@query
def fastq_records(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with a quality for each letter, written as FASTQ files and read again."""
    sound = reads(spark, sf).where("length(qual) = length(seq)").select("name", "seq", "qual")
    path = scratch(spark, "fastq")
    sound.select(F.concat(F.lit("@"), "name", F.lit(" x\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)
    return fastx.read_fastq(spark, path).select("name", "comment", "seq", "qual")


# A matrix of nucleotide scores that is not symmetric.
_MATRIX = """
    A       C       G       T       N
A   91      -114    -31     -123    0
C   -114    100     -125    -31     0
G   -31     -125    100     -114    0
T   -123    -31     -144    91      0
N   0       0       0       0       0
"""


@query
def matrix_file(spark: SparkSession, sf: str) -> DataFrame:
    """A score matrix written to a file and read again, as rows."""
    path, p = scratch(spark, "matrix"), Params()
    spark.createDataFrame([("# scores\n" + _MATRIX,)], "value string").coalesce(1).write.text(path)
    s = fastx.read_matrix(path, p, spark)
    rows = [(a, b, int(s[i, j])) for i, a in enumerate(p.letters) for j, b in enumerate(p.letters)]
    return spark.createDataFrame(rows, "a string, b string, score long")


@query
def amino_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Letters of posts as codes of the 27-letter alphabet."""
    codes = _table(spark, sf, "documents").where("text <> ''").select("doc_id", S.amino_codes("text").alias("c"))
    return codes.select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("c", lambda x: x == 26)).cast("long").alias("unknown"))


# Expressions ---------------------------------------------------------------------------


@query
def residue_codes(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).select("group_id", "read_id", S.encode("seq").alias("codes")).withColumn("letters", S.decode("codes"))


@query
def reverse_complements(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).select("group_id", "read_id", S.reverse_complement("seq").alias("seq"))


@query
def quality_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = reads(spark, sf).where("qual <> ''").select("group_id", "read_id", S.quality_weights("qual").alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("group_id", "read_id", F.size("w").cast("long").alias("n"), total.alias("total"), F.array_min("w").cast("long").alias("low"))


@query
def score_matrix(spark: SparkSession, sf: str) -> DataFrame:
    p = Params()
    s = p.scores()
    rows = [(a, b, int(s[i, j])) for i, a in enumerate(p.letters) for j, b in enumerate(p.letters)]
    return spark.createDataFrame(rows, "a string, b string, score long")


@query
def gap_costs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 201).select(F.col("id").alias("n"), S.gap_cost("id", Params()).alias("cost"))


@query
def length_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("group_id").orderBy(F.desc(F.length("seq")), "read_id")
    return reads(spark, sf).select("group_id", "read_id", F.row_number().over(w).cast("long").alias("place"))


# Words and minimisers ------------------------------------------------------------------


@query
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = sketch.words(reads(spark, sf), ["group_id", "read_id"], "seq", 19)
    each = w.groupBy("group_id", "word", "read_id").agg(F.count("*").alias("n"))
    return each.groupBy("group_id", "word").agg(F.sum("n").alias("n"), F.count("*").alias("reads"))


@query
def word_hashes(spark: SparkSession, sf: str) -> DataFrame:
    w = sketch.words(reads(spark, sf), ["group_id", "read_id"], "seq", 19)
    h = w.select("group_id", "read_id", S.hash_word(S.word_code("word"), 38).alias("h"))
    return h.groupBy("group_id", "read_id").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"), F.bit_xor("h").alias("mixed"))


def _minis(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.minimisers(reads(spark, sf))


@query
def minimisers(spark: SparkSession, sf: str) -> DataFrame:
    return _minis(spark, sf).select("group_id", "read_id", "hash", "last")


@query
def minimisers_of_both_strands(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.minimisers(reads(spark, sf), Params(both_strands=True)).select("group_id", "read_id", "hash", "last", F.col("strand").cast("int").alias("strand"))


@query
def shared_minimisers(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.shared(_minis(spark, sf))


@query
def minimiser_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.jaccard(_minis(spark, sf))


@query
def guide_first_pair(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.first_pair(sketch.jaccard(_minis(spark, sf)))


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.anchors(_minis(spark, sf), reads(spark, sf), Params().k)


@query
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _anchors(spark, sf).drop("strand")


@query
def chain_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.chain_pairs(_anchors(spark, sf), Params().k).drop("strand").withColumn("score", F.col("score").cast("long"))


# Aligned rows --------------------------------------------------------------------------


@query
def msa_cells(spark: SparkSession, sf: str) -> DataFrame:
    return columns.cells(_rows(spark, sf))


@query
def column_depth(spark: SparkSession, sf: str) -> DataFrame:
    return columns.depth(_rows(spark, sf))


@query
def most_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return columns.voted_consensus(_rows(spark, sf))


@query
def phred_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = columns.votes(_rows(spark, sf))
    return v.select("group_id", "col", "cov", "n", S.phred("cov", "n").cast("long").alias("phred"))


@query
def edges(spark: SparkSession, sf: str) -> DataFrame:
    return columns.edges(_rows(spark, sf))


@query
def edge_reads(spark: SparkSession, sf: str) -> DataFrame:
    return columns.edge_reads(_rows(spark, sf))


@query
def node_weights(spark: SparkSession, sf: str) -> DataFrame:
    return columns.node_weights(columns.edges(_rows(spark, sf)))


@query
def path_scores(spark: SparkSession, sf: str) -> DataFrame:
    return columns.path_scores(columns.edges(_rows(spark, sf)))


@query
def het_sites(spark: SparkSession, sf: str) -> DataFrame:
    return columns.sites(_rows(spark, sf))


@query
def het_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return columns.profiles(_rows(spark, sf))


@query
def het_priority(spark: SparkSession, sf: str) -> DataFrame:
    return columns.priorities(columns.profiles(_rows(spark, sf)))


@query
def read_distances(spark: SparkSession, sf: str) -> DataFrame:
    return columns.distances(_rows(spark, sf))


@query
def farthest_pair(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return columns.farthest(rows, columns.distances(rows))


def _unpadded(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without the gaps at their end; as in ``_rows``, a null group has none."""
    rows = _table(spark, sf, "seq_reads").where("seq is not null and seq <> '' and group_id is not null")
    kept = rows.groupBy("group_id", "read_id").agg(F.min_by("seq", "read_key").alias("seq"))
    return kept.select("group_id", "read_id", S.residues("seq").alias("aligned"))


@query
def cluster_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return columns.two_clusters(_unpadded(spark, sf))


@query
def cluster_medoids(spark: SparkSession, sf: str) -> DataFrame:
    return columns.two_clusters(_unpadded(spark, sf), "medoids")


@query
def cluster_cover(spark: SparkSession, sf: str) -> DataFrame:
    return columns.two_clusters(_unpadded(spark, sf), "cover")


@query
def aligned_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows taken apart into cells and put together again."""
    rows = _rows(spark, sf)
    widths = rows.groupBy("group_id").agg(F.max(F.length("aligned")).alias("width"))
    return columns.rows_of(columns.cells(rows), widths)



def _gfa_ids(rows: DataFrame) -> DataFrame:
    nodes = columns.cells(rows).select("group_id", "col", "base").distinct()
    nth = F.dense_rank().over(Window.partitionBy("group_id").orderBy("col", "base"))
    return nodes.select("group_id", "col", "base", nth.cast("string").alias("id"), F.concat(F.col("col").cast("string"), "base").alias("node"))


@query
def gfa_segments_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _gfa_ids(_rows(spark, sf)).select("group_id", F.concat(F.lit("S\t"), "id", F.lit("\t"), "base").alias("line"))


@query
def gfa_links_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    side = lambda x: _gfa_ids(rows).select("group_id", F.col("node").alias(f"{x}_node"), F.col("id").alias(f"{x}_id"))
    e = columns.edges(rows).join(side("from"), ["group_id", "from_node"]).join(side("to"), ["group_id", "to_node"])
    return e.select("group_id", F.concat(F.lit("L\t"), "from_id", F.lit("\t+\t"), "to_id", F.lit("\t+\t0M")).alias("line"))


@query
def gfa_paths_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    steps = columns.cells(rows).join(_gfa_ids(rows).select("group_id", "col", "base", "id"), ["group_id", "col", "base"])
    way = steps.groupBy("group_id", "read_id").agg(F.sort_array(F.collect_list(F.struct("col", "id"))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: F.concat(s.id, F.lit("+"))), ",")
    return way.select("group_id", F.concat(F.lit("P\t"), (F.col("read_id") + 1).cast("string"), F.lit("\t"), text, F.lit("\t*")).alias("line"))


@query
def gfa_path_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The segments of each graph as S lines and one path, parsed and joined."""
    t = _table(spark, sf, "gfa_segments").select("group_id", F.trim("name").alias("name"), "seq", "seg_key").where("name <> '' and seq is not null and seq <> ''")
    first = t.groupBy("group_id", "name").agg(F.min_by("seq", "seg_key").alias("seq"))
    s_lines = first.select("group_id", F.concat(F.lit("S\t"), "name", F.lit("\t"), S.residues("seq")).alias("line"))
    names = first.groupBy("group_id").agg(F.sort_array(F.collect_list("name")).alias("n"))
    p_lines = names.select("group_id", F.concat(F.lit("P\tall\t"), F.array_join(F.transform("n", lambda x: F.concat(x, F.lit("+"))), ","), F.lit("\t*")).alias("line"))
    lines = s_lines.unionByName(p_lines)
    out = gfa.walked(gfa.segments(lines, "line", "group_id"), gfa.path_steps(lines, "line", "group_id"), "group_id")
    return out.select("group_id", F.col("at").cast("long").alias("at"), "name", "next_name", "seq")


def queries() -> dict[str, Query]:
    from braidwork import catalog_graphs

    return _QUERIES | catalog_graphs.QUERIES


def oracle_sql() -> dict[str, str]:
    from braidwork import catalog_graphs

    return catalog_sql.ORACLE | catalog_graphs.ORACLE
