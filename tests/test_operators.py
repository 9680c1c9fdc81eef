"""Operators and sources on small tables, the stream against the batch, and the SQL of some queries."""

import collections
import gzip
import math
import os

import pytest
from pyspark.sql import functions as F

from braidwork import aligner, catalog, catalog_sql
from braidwork.aligner import Aligner
from braidwork.functions import sequences as S
from braidwork.kernels.params import Params
from braidwork.operators import audit, columns, poa, reject
from braidwork.plans import grouping
from braidwork.sources import fastx, gfa
from braidwork.streaming import incremental

READS = [("g", 0, "a", "ACGTACGT", None), ("g", 1, "b", "ACGACGT", None), ("g", 2, None, "ACGTACGT", None), ("h", 0, "c", "", None), (None, 0, "d", "ACGT", None), ("h", 1, "e", None, None)]
SCHEMA = "group_id string, read_id int, name string, seq string, qual string"
DATA = "/root/testdata/sf0.001"


def test_reject(spark):
    lines = [
        (1, "f", 1, "reads_csv", '0,a,,ACGT,'), (2, "f", 2, "reads_csv", '1,b,"x, ""y""",acgu,"II,I"'), (3, "f", 3, "reads_csv", '2,c,a"b,ACGT,'), (4, "f", 4, "reads_csv", None),
        (5, "f", 5, "reads_csv", "3,d,,ACGT"), (6, "f", 6, "reads_csv", "x,d,,ACGT,"), (7, "f", 7, "reads_csv", "4,d e,,ACGT,"), (8, "f", 8, "reads_csv", "5,e,,ACX,"), (9, "f", 9, "reads_csv", "6,e,,ACG,II"),
        (10, "g", 2, "gfa_s", "S\ts1\tACGT"), (11, "g", 1, "gfa_s", "S\ts1\tAC\tLN:i:2"), (12, "h", 3, "gfa_s", "S\ts1\tAC"), (13, "g", 3, "gfa_s", "L\ts1\tAC"), (14, "g", 4, "gfa_s", "S\t\tAC"), (15, "g", 5, "gfa_s", "S\tq\t"),
        (16, None, 1, "gfa_s", "S\ts1\tA"), (17, None, 2, "gfa_s", "S\ts1\tA"), (18, "f", 10, "other", "x"), (19, "f", 11, "reads_csv", '7,"q",,"AC",""""'), (20, "f", 12, "reads_csv", '8,"q"x,,AC,'), (21, "f", 13, "reads_csv", ""),
        (22, "f", 14, "reads_csv", "9" * 30 + ",n,\x01,A,"),
    ]
    df = spark.createDataFrame(lines, "raw_id int, source_file string, line_no int, rec_format string, raw_line string").withColumn("errors", F.lit(1)).withColumn("name", F.lit("clash"))
    parsed = reject.parse_lines(df, "raw_id", "source_file", "line_no", "rec_format", "raw_line")
    got = {r.key: r.reason for r in reject.rejected(parsed).collect()}
    assert got == {3: "quoting", 4: "columns", 5: "columns", 6: "read_id", 7: "name", 8: "seq", 9: "qual", 10: "duplicate_name", 13: "columns", 14: "name", 15: "seq", 17: "duplicate_name", 18: "format", 19: "qual", 20: "quoting", 21: "columns"}
    rows = {r.key: r for r in reject.accepted(parsed).collect()}
    assert set(rows) == {1, 2, 11, 12, 16, 22} and rows[2].comment == 'x, "y"' and rows[2].qual == "II,I" and rows[11].tags == ["LN:i:2"] and rows[22].read_id is None and rows[22].comment == "\x01"
    assert reject.rejected(reject.parse_lines(df.limit(0), "raw_id", "source_file", "line_no", "rec_format", "raw_line")).count() == 0


def test_long_quoted_line(spark):
    line = '1,n,"' + '""' * 50_000 + '",ACGT,'
    df = spark.createDataFrame([(1, "f", 1, "reads_csv", line)], "a int, b string, c int, d string, e string")
    assert len(reject.accepted(reject.parse_lines(df, "a", "b", "c", "d", "e")).first().comment) == 50_000


def test_poa_and_outputs(spark, tmp_path):
    df = spark.createDataFrame(READS, SCHEMA).withColumn("x", F.lit(1)).withColumn("weight", F.lit(2))
    r = poa.poa(df).cache()
    assert {x.group_id: x.n_seq for x in r.collect()} == {"g": 3, "h": 2, None: 1}
    cons = {x.group_id: x.seq for x in poa.part(r, "consensus").collect()}
    assert cons == {"g": "ACGTACGT", None: "ACGT"}
    lines = [x.line for x in poa.consensus_lines(r.where("group_id = 'g'")).orderBy("ord").collect()]
    assert lines == [">Consensus_sequence", "ACGTACGT"]
    assert [x.line for x in poa.consensus_lines(r.where("group_id = 'g'").withColumn("b", F.lit(7)), True, "b").orderBy("ord").collect()][0] == "@Consensus_sequence_7"
    msa = [x.line for x in poa.msa_lines(r.where("group_id = 'g'")).orderBy("ord").collect()]
    assert msa[::2] == [">a", ">b", ">Seq_3", ">Consensus_sequence"] and msa[3].replace("-", "") == "ACGACGT"
    graph = poa.gfa_lines(r.where("group_id = 'g'"), True).orderBy("section", "ord").collect()
    assert graph[0].line == "H\tVN:Z:1.0\tNS:i:8\tNL:i:8\tNP:i:4" and graph[-1].line.startswith("P\tConsensus_sequence\t1+,2+")
    numbered = spark.createDataFrame([("g", i, x.line) for i, x in enumerate(graph[:-1])], "group_id string, line_no int, line string")
    back = poa.from_gfa(numbered)
    assert {x.aligned.replace("-", "") for x in poa.part(back, "msa").collect()} == {"ACGTACGT", "ACGACGT"}
    assert poa.from_aligned(poa.part(r, "msa")).count() == 2
    assert poa.dot_lines(r).where("line like 'digraph%'").count() == 2
    poa.write_lines(poa.msa_lines(r), str(tmp_path / "out"))
    assert [x.value for x in spark.read.text(str(tmp_path / "out" / "group_id=g")).collect()] == msa
    assert poa.poa(df.limit(0)).count() == 0
    one, eight = (sorted(map(str, poa.part(poa.poa(df.repartition(n)), "edges").collect())) for n in (1, 8))
    assert one == eight


def test_stream_equals_batch(spark, tmp_path):
    rows = [r for r in READS if r[0] == "g"]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = incremental.consensus_stream(src).writeStream.outputMode("update").format("memory").queryName("called").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("select * from called order by n_seq desc").first()
    batch = poa.part(poa.poa(spark.createDataFrame(rows, SCHEMA)), "consensus").first()
    assert (last.n_seq, last.seq, last.qual) == (3, batch.seq, batch.qual)


def test_incremental_equals_batch(spark):
    df = spark.createDataFrame([r for r in READS if r[0] == "g"], SCHEMA)
    state = incremental.add(None, df.where("read_id < 1"))
    state = incremental.add(state, df.where("read_id >= 1"))
    a, b = (sorted(map(str, poa.part(x, "edges").collect())) for x in (incremental.finish(state), poa.poa(df)))
    assert a == b


def test_sources(spark, tmp_path):
    text = "junk\n>a one two\nACG\nT\n>b\n\n>c\tx\nAC GT\n"
    assert fastx.parse_fastx(text) == [("a", "one two", "ACGT", None), ("b", None, "", None), ("c", "x", "ACGT", None)]
    fq = "@r1 c\nACGT\n+\n@>+I\n@r2\nAC\nGT\n+r2\nII\nII\n"
    assert fastx.parse_fastx(fq) == [("r1", "c", "ACGT", "@>+I"), ("r2", None, "ACGT", "IIII")]
    with pytest.raises(ValueError):
        fastx.parse_fastx("@r\nACGT\n+\nII\n")
    assert fastx.parse_fastx(">c\tx y\nA\x0bC\n> z\nG\r\n") == [("c", "x y", "AC", None), ("", "z", "G", None)]
    records = [(f"n{i}", f"c {i}" if i % 3 else None, "ACGT" * (1 + i % 5), ("@" if i % 4 == 0 else "I") + "+>@I" [: 3] + "I" * (4 * (i % 5))) for i in range(200)]
    (tmp_path / "big.fq").write_text("".join(f"@{n}{' ' + c if c else ''}\n{s}\n+\n{q}\n" for n, c, s, q in records))
    for size in (200, 333, 700, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert sorted(((r.name, r.comment, r.seq, r.qual) for r in fastx.read_fastq(spark, str(tmp_path / "big.fq")).collect()), key=str) == sorted(records, key=str)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "a.fa").write_text(">a one\nACG\nT\n>b\nAC\n")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(fq.encode()))
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fq.gz")
    assert sorted((r.name, r.comment, r.seq) for r in fastx.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("a", "one", "ACGT"), ("b", None, "AC")]
    got = fastx.read_list(spark, str(tmp_path / "list")).collect()
    assert {r.group_id for r in got} == {f"{tmp_path}/a.fa", f"{tmp_path}/b.fq.gz"}
    assert {(r.batch_index, r.read_id, r.name) for r in got} == {(1, 0, "a"), (1, 1, "b"), (2, 0, "r1"), (2, 1, "r2")}
    (tmp_path / "m").write_text("# x\n  A C\nA 3 -1\nC -2 4\n* -5 -5\n")
    m = fastx.read_matrix(str(tmp_path / "m"), Params())
    assert m[0].tolist()[:2] == [3, -1] and m[1].tolist()[:2] == [-2, 4] and m[4].tolist()[:2] == [-5, -5]
    lines = spark.createDataFrame([("S\ta\tAC\tLN:i:2",), ("S\tb\tG",), ("P\tp\ta+,b+\t*",), ("P\tq\ta+,z+\t*",)], "line string")
    seg, steps = gfa.segments(lines), gfa.path_steps(lines)
    assert seg.select(gfa.tag("tags", "LN")).first()[0] == "2"
    assert [(r.name, r.next_name) for r in gfa.walked(seg, steps).where("path = 'p'").orderBy("at").collect()] == [("a", "b"), ("b", None)]
    assert [r.name for r in gfa.missing(seg, steps).collect()] == ["z"]


def test_expressions(spark):
    r = spark.createDataFrame([("acgUnX", "I!", 0, 8)], "s string, q string, a int, b int").select(
        S.encode("s"), S.decode(F.lit("0123459")), S.reverse_complement("s"), S.quality_weights("q"), S.ilog2("a"), S.ilog2("b"), S.amino_codes(F.lit("Mk-")), S.hash_word(F.lit(5).cast("long"), 10), S.path_score(F.lit(0), F.lit(3)), S.path_score(F.lit(1), F.lit(3))
    ).first()
    assert r[0] == "012344" and r[1] == "ACGTN-9" and r[2] == "NNACGT" and r[3] == [41, 1] and (r[4], r[5]) == (-1, 3) and r[6] == [14, 12, 26] and r[8] == 0 and r[9] == -1
    from braidwork.kernels import seed
    import numpy as np

    assert r[7] == int(seed.hash_words(np.array([5], np.uint64), 10)[0])


def test_columns(spark):
    rows = spark.createDataFrame([("g", i, a) for i, a in enumerate(["AC-", "AC-", "AGT", "AGT"])], "group_id string, read_id int, aligned string")
    assert {(r.site, r["count"], r.var_type) for r in columns.profiles(rows).collect()} == {(1, 2, 0)}
    assert {(r.i, r.j, r.dis) for r in columns.distances(rows).collect()} == {(0, 2, 4), (0, 3, 4), (1, 2, 4), (1, 3, 4)}
    assert columns.voted_consensus(rows).first().seq == "ACT"
    far = columns.farthest(rows, columns.distances(rows))
    assert [tuple(r) for r in far.collect()] == [("g", 0, 2, 4)]
    tied = spark.createDataFrame([("g", i, "A" + x) for i, x in enumerate("CCGGNN")], rows.schema)  # the last two are as far from one as from the other
    d = columns.distances(tied)
    assert {r.read_id: r.cluster for r in columns.assign(tied, d, columns.farthest(tied, d)).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    assert columns.rows_of(columns.cells(rows), spark.createDataFrame([("g", 3)], "group_id string, width int")).where("aligned = 'AC-'").count() == 2


def _shuffles_and_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


@pytest.fixture(scope="module")
def parted(spark):
    """Groups with ties, gaps, odd letters, rows of unequal length and none at all, with their clusters by joins."""
    import random

    r = random.Random(3)
    rows = [("one", 5, "ACGT"), ("alike", 1, "AC"), ("alike", 2, "AC"), ("odd", 0, "Aé"), ("odd", 1, "Aé"), ("odd", 2, "Cß"), ("odd", 4, "Cß")]
    for g in range(12):
        kinds = ["".join(r.choice("ACGTN") for _ in range(9)) for _ in range(3)]
        for i in r.sample(range(50), r.randint(2, 14)):
            rows.append((f"g{g}", i, "".join(x if r.random() < 0.85 else r.choice("ACGT-") for x in r.choice(kinds))[: r.randint(6, 9)]))
    short = spark.createDataFrame(rows, "group_id string, read_id int, aligned string")
    width = collections.Counter()
    for g, _, a in rows:
        width[g] = max(width[g], len(a))
    full = spark.createDataFrame([(g, i, a.ljust(width[g], "-")) for g, i, a in rows], short.schema)
    d = columns.distances(full).localCheckpoint()
    return short, full, d, columns.assign(full, d, columns.farthest(full, d)).localCheckpoint()


def test_two_clusters_reads(spark, parted, monkeypatch):
    short, _, _, clusters = parted
    want = sorted(map(tuple, clusters.collect()))
    assert len(want) > 40 and sorted(map(tuple, columns.two_clusters(short).collect())) == want
    batch = [b for b in short.where("group_id = 'g3'").orderBy("read_id").toArrow().to_batches()]
    monkeypatch.setattr(columns, "_PART", 2)  # parts of reads
    got = [x for b in columns._two_clusters(0.25, "reads")(batch) for x in b.to_pylist()]
    assert [tuple(x.values()) for x in got] == [x for x in want if x[0] == "g3"]
    if os.path.exists(DATA):
        assert _shuffles_and_joins(catalog.queries()["cluster_assignment"](spark, DATA)) == (2, 0)


def test_two_clusters_medoids(spark, parted):
    short, _, d, clusters = parted
    want = sorted(map(tuple, columns.medoids(d, clusters).collect()))
    assert len(want) > 12 and sorted(map(tuple, columns.two_clusters(short, "medoids").collect())) == want
    if os.path.exists(DATA):
        assert _shuffles_and_joins(catalog.queries()["cluster_medoids"](spark, DATA)) == (2, 0)


def test_two_clusters_cover(spark, parted):
    short, full, _, clusters = parted
    want = sorted(map(tuple, columns.cluster_cover(full, clusters).collect()))
    assert len(want) > 100 and sorted(map(tuple, columns.two_clusters(short, "cover").collect())) == want
    if os.path.exists(DATA):
        assert _shuffles_and_joins(catalog.queries()["cluster_cover"](spark, DATA)) == (2, 0)


@pytest.mark.skipif(not os.path.exists(DATA), reason="the test tables are not there")
@pytest.mark.parametrize("name", ["p4_found", "fasta_records", "quality_weights", "minimisers", "minimiser_jaccard", "most_frequent", "het_profiles", "gfa_path_walk"])
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("seq_reads", "raw_records", "gfa_segments"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.execute(catalog_sql.ORACLE[name])
    cols = [d[0] for d in want.description]
    tidy = lambda r: tuple(round(x, 5) if isinstance(x, float) and not math.isnan(x) else x for x in r)
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    assert collections.Counter(tidy(r) for r in got.select(*cols).collect()) == collections.Counter(map(tidy, want.fetchall()))


@pytest.mark.skipif(not os.path.exists(DATA), reason="the test tables are not there")
def test_graphs_fold_all_reads(spark, monkeypatch):
    table, seen = catalog._table, set()
    monkeypatch.setattr(catalog, "_table", lambda s, sf, name: seen.add(name) or table(s, sf, name).where("group_id = 'g000000005' and read_id < 2"))
    names = [n for n in catalog.queries() if n.startswith("poa_")]
    assert len(names) == 25
    for name in names:
        seen.clear()
        catalog.queries()[name](spark, DATA)
        assert seen == {"seq_reads"}, name
    of_group = lambda df: {r.group_id: r["count"] for r in df.groupBy("group_id").count().collect()}
    assert of_group(catalog.queries()["poa_rows"](spark, DATA)) == of_group(catalog.reads(spark, DATA)) == {"g000000005": 2}


def test_audit_finds_faults(spark):
    df = spark.createDataFrame(READS[:3], SCHEMA)
    good = poa.poa(df)
    assert [c for c, x in audit.audit(good, df).first().asDict().items() if x] == ["group_id", "n_seq", "letters", "edge_weight", "source_reads"]
    edges = F.transform("edges", lambda e: F.when((e.from_id == 2), e.withField("weight", F.lit(0)).withField("read_ids", F.lit(None).cast("array<int>"))).otherwise(e))
    bad = good.withColumn("edges", F.filter(edges, lambda e: e.to_id != 5)).withColumn("msa", F.transform("msa", lambda m: m.withField("aligned", F.lit("AC"))))
    got = audit.audit(bad, df).first()
    assert got.unbalanced > 0 and got.astray > 0 and got.ragged == 3 and got.misspelt == 3


def test_restore_and_weights(spark):
    df = spark.createDataFrame(READS[:3], SCHEMA)
    rows = poa.part(poa.poa(df.where("read_id < 2")), "msa")
    state = incremental.add(incremental.from_aligned(rows), df.where("read_id = 2"))
    got = poa.part(incremental.finish(state), "msa").orderBy("read_id").collect()
    assert [r.aligned.replace("-", "") for r in got] == ["ACGTACGT", "ACGACGT", "ACGTACGT"]
    weighted = df.withColumn("w", F.when(F.col("read_id") == 1, F.array_repeat(F.lit(9), 7)))
    assert poa.part(poa.poa(weighted, weights="w"), "consensus").first().seq == "ACGACGT"
    for bad in (F.array(F.lit(1)), F.array_repeat(F.lit(-1), F.length("seq"))):
        with pytest.raises(Exception, match="weights must be"):
            poa.poa(df.withColumn("w", bad), weights="w").collect()
    stray = spark.createDataFrame([("g", i % 3, "ACGT"[: 1 + i % 4]) for i in range(7)] + [(None, 0, "A"), (None, 0, "A")], "group_id string, read_id int, seq string")
    got = {r.group_id: r.n_seq for r in poa.poa(stray, name=None, qual=None, partitions=1).collect()}
    assert got == {"g": 7, None: 2}


def test_aligner(spark, tmp_path):
    a = Aligner(spark)
    assert a.msa(["ACGTACGT", "ACGACGT"]).of_one()["cons_seq"] == ["ACGTACGT"]
    for bad in (lambda: a.add(["A"]), lambda: a.output(), lambda: a.msa(["A"], quals=["I", "I"]), lambda: a.restore()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        a.align("ACGT")
    got = a.align(["ACGTACGT", "ACGACGT"]).add(["ACGTACGT"]).output().of_one()
    assert (got["n_seq"], got["cons_seq"], [x.replace("-", "") for x in got["msa_seq"]]) == (3, ["ACGTACGT"], ["ACGTACGT", "ACGACGT", "ACGTACGT", "ACGTACGT"])
    assert a.msa(["ACGT", "ACGT", "ACGA"], quals=[[1] * 4, [1] * 4, [9] * 4]).of_one()["cons_seq"] == ["ACGA"]
    df = spark.createDataFrame(READS, SCHEMA)
    result = a.msa(df)
    starts = {0: ">Consensus_sequence", 1: ">a", 2: ">a", 3: "H\tVN:Z:1.0", 4: "H\tVN:Z:1.0", 5: "@Consensus_sequence"}
    for mode, start in starts.items():
        result.write(str(tmp_path / str(mode)), mode)
        lines = [x.value for x in spark.read.text(str(tmp_path / str(mode) / "group_id=g")).collect()]
        assert lines[0].startswith(start) and (lines[-1].startswith("P\tConsensus_sequence") if mode == 4 else True)
    with pytest.raises(ValueError):
        result.lines(6)
    again = Aligner(spark).restore(rows=result.rows.where("group_id = 'g'")).add(df.where("group_id = 'g' and read_id = 1")).output()
    assert again.frame.first().n_seq == 4
    report = aligner.run(df, 2, str(tmp_path / "run"))
    assert report["reads"] == 6 and report["seconds"] > 0 and report["peak_gb"] > 0


def test_parts_of_graphs(spark):
    df = spark.createDataFrame([("g", 0, None, "ACGTACGTAC", None, None, None), ("g", 1, None, "GTTC", None, 4, 7)], SCHEMA + ", a int, b int")
    rows = poa.part(incremental.finish(incremental.add(None, df, nodes=("a", "b"))), "msa").orderBy("read_id").collect()
    assert [r.aligned.replace("-", "") for r in rows] == ["ACGTACGTAC", "GTTC"]
    with pytest.raises(Exception, match="no part of the graph"):
        incremental.add(None, df.withColumn("b", F.lit(99)), nodes=("a", "b")).collect()


def test_groups_over_batches():
    import pyarrow as pa

    cut = lambda *r: pa.RecordBatch.from_pydict({"g": [x[0] for x in r], "v": [x[1] for x in r]})
    got = list(grouping.each_group([cut((None, 0)), cut((None, 1), ("a", 2)), cut(("a", 3)), cut(("b", 4), ("c", 5))], "g"))
    assert [(k, c["v"]) for k, c in got] == [(None, [0, 1]), ("a", [2, 3]), ("b", [4]), ("c", [5])]
    assert list(grouping.each_group([], "g")) == []
