"""The fold compiled for the JVM against the numpy kernels."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork import catalog_graphs
from braidwork.kernels import jvm
from braidwork.kernels.fold import fold
from braidwork.kernels.params import Params
from braidwork.operators import audit, columns, poa
from braidwork.sources import gfa
from braidwork.streaming import incremental

SETTINGS = {
    "convex": {}, "linear": {"gap_open": (0, 0)}, "affine": {"gap_open": (4, 0)}, "local": {"mode": "local"}, "local_affine": {"mode": "local", "gap_open": (4, 0)}, "extend": {"mode": "extend", "zdrop": 100},
    "strand": {"both_strands": True}, "quality": {"use_quality": True}, "longest_first": {"longest_first": True}, "path_score": {"path_score": True}, "path_linear": {"path_score": True, "gap_open": (0, 0)},
    "on_right": {"gap_on_right": True}, "at_end": {"gap_at_end": True}, "frequent": {"consensus": "frequent"}, "no_band": {"band": -1}, "narrow": {"band": 2, "band_part": 0.0},
}


def _reads():
    rnd, rows = random.Random(5), []
    for group, (n, length) in {"a": (7, 90), "b": (1, 30), "c": (12, 40), None: (3, 50), "d": (5, 150)}.items():
        truth = [rnd.choice("ACGT") for _ in range(length)]
        for i in range(n):
            seq = "".join(rnd.choice([c, c, c, c, c, c, c, rnd.choice("ACGTNn"), "", c + rnd.choice("acgt")]) for c in truth[rnd.randrange(9) :])
            if group == "d" and i % 2:
                seq = seq[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
            rows.append((group, i, f"r{i}", [seq, None, "", "é𝒳" + seq][0 if i != 3 else len(rows) % 4], "".join(chr(rnd.randrange(33, 70)) for _ in seq) if i % 3 else None))
    return rows


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(_reads(), "group_id string, read_id int, name string, seq string, qual string").cache()


@pytest.mark.parametrize("name", SETTINGS)
def test_compiled_fold_is_the_numpy_fold(reads, name, monkeypatch):
    params = Params(**SETTINGS[name])
    assert jvm.supported(params) and jvm.available(reads.sparkSession)
    key = lambda r: (r.group_id is not None, r.group_id or "")
    got = sorted(poa.poa(reads, params).collect(), key=key)
    monkeypatch.setattr(jvm, "available", lambda spark: False)
    assert got == sorted(poa.poa(reads, params).collect(), key=key)


SEEDED = {
    "plain": {}, "strand": {"both_strands": True}, "affine": {"gap_open": (4, 0)}, "linear": {"gap_open": (0, 0)}, "path_score": {"path_score": True}, "quality": {"use_quality": True, "both_strands": True},
    "longest_first": {"longest_first": True, "both_strands": True}, "no_band": {"band": -1}, "near": {"k": 8, "w": 2, "min_window": 0}, "wide": {"k": 28, "w": 40, "min_window": 200}, "amino": {"amino": True, "k": 7, "w": 4}, "local": {"mode": "local"},
}


@pytest.fixture(scope="module")
def long_reads(spark):
    rnd, rows = random.Random(11), []
    some = lambda n: [rnd.choice("ACGT") for _ in range(n)]
    tandem = some(60)
    for group, truth in {"a": some(400), "b": some(120) + 5 * tandem + some(150), "c": some(250) + ["N"] * 30 + some(250), None: 12 * some(40), "e": some(70)}.items():
        for i in range(6):
            kept = truth if i != 4 else truth[200:] + truth[:150]  # a read whose parts changed places
            seq = "".join(rnd.choice([c] * 40 + [rnd.choice("ACGTN"), "", c + rnd.choice("ACGTac")]) for c in kept)
            if i % 3 == 2:
                seq = seq[::-1].translate(str.maketrans("ACGTac", "TGCAtg"))
            seq = [seq, "ACGT", "", None, seq][i - 1 if group == "b" and 1 <= i <= 3 else 0]
            rows.append((group, i, f"r{i}", seq, "".join(chr(rnd.randrange(33, 70)) for _ in seq or "") if i % 2 else None))
    return spark.createDataFrame(rows, "group_id string, read_id int, name string, seq string, qual string").cache()


@pytest.mark.parametrize("name", SEEDED)
def test_compiled_seeding_is_that_of_the_numpy_fold(long_reads, name, monkeypatch):
    params = Params(**({"seeding": True, "k": 11, "w": 5, "min_window": 50} | SEEDED[name]))
    key = lambda r: (r.group_id is not None, r.group_id or "")
    made = poa.poa(long_reads, params)
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted(made.collect(), key=key)
    monkeypatch.setattr(jvm, "available", lambda spark: False)
    assert got == sorted(poa.poa(long_reads, params).collect(), key=key)


def test_loops_over_several_cells_are_those_over_single_cells(spark):
    one, many = jvm._kernel(spark, "Fold$Loops"), jvm._kernel(spark, "Lanes")
    assert any(m.getName() == "linear" for m in many.getClass().getDeclaredMethods())
    rnd, new, kind = random.Random(3), spark._sc._gateway.new_array, spark._jvm.int
    lanes, none = many.getClass().getField("lanes").getInt(many), -(1 << 28)

    def ints(values):
        out = new(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    for width in (1, 2, lanes - 1, lanes, lanes + 1, 29, 67):
        for start, cost, least in ((none, 0, -(1 << 31)), (0, 0, 0), (7, -3, -(1 << 31))):
            before = ints([none] * lanes + [rnd.choice([none, rnd.randrange(-90, 90)]) for _ in range(width + 3)] + [none] * 3 * lanes)
            letters = ints([rnd.choice([2, -4, 0]) for _ in range(width + 2 * lanes)])
            made = []
            for loops in (one, many):
                h = ints([0] * (width + 4 * lanes))
                loops.linear(before, lanes, cost, start, letters, 0, h, lanes, width, 2, least)
                loops.fence(h, 0, lanes + width, lanes + (width + lanes - 1) // lanes * lanes + lanes)
                best = loops.most(h, lanes, width)
                made.append((list(h)[lanes : lanes + width], best, loops.ends(h, lanes, width, best)))
            cells, best, _ = made[0]
            assert made[0] == made[1] == (cells, max(cells), cells.index(best) << 32 | width - 1 - cells[::-1].index(best))


def test_weights_reach_the_compiled_fold(reads, monkeypatch):
    weighted = reads.withColumn("w", F.when(F.col("read_id") % 2 == 0, F.sequence(F.lit(0), F.greatest(F.length(F.coalesce("seq", F.lit(""))) - 1, F.lit(0)))))
    weighted = weighted.where("seq is not null and seq <> ''")
    got = sorted(map(str, poa.poa(weighted, weights="w").collect()))
    monkeypatch.setattr(jvm, "available", lambda spark: False)
    assert got == sorted(map(str, poa.poa(weighted, weights="w").collect()))


@pytest.mark.parametrize("name", SETTINGS)
def test_counts_where_the_graph_is_made_are_those_of_its_audit(reads, name):
    params = Params(**SETTINGS[name])
    whole = reads.where("seq is not null and seq <> ''")
    wanted = audit.audit(poa.poa(whole, params).cache(), whole)
    got = poa.counted(whole, params)
    assert got.schema == wanted.schema or got.dtypes == wanted.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.where("group_id is not null").collect() + [r for r in got.collect() if r.group_id is None]))


@pytest.mark.parametrize("name", ["convex", "strand", "quality", "frequent", "longest_first"])
@pytest.mark.parametrize("with_consensus", [True, False])
def test_lines_made_where_the_graph_is_are_those_of_its_tables(reads, name, with_consensus, monkeypatch):
    params = Params(**SETTINGS[name])
    known = reads.where("group_id is not null")
    rows = poa.gfa_lines(poa.poa(known, params).cache(), with_consensus).orderBy("group_id", "section", "ord").collect()
    graphs = poa.graph_lines(known, params, with_consensus)
    assert graphs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    graphs = graphs.cache()
    made = graphs.select("group_id", F.posexplode(F.concat("lines", "paths.line")).alias("at", "line")).orderBy("group_id", "at").collect()
    assert [(r.group_id, r.line) for r in made] == [(r.group_id, r.line) for r in rows]
    reads_of = graphs.select("group_id", F.explode("paths.read").alias("read")).collect()
    assert sorted(map(str, reads_of)) == sorted(f"Row(group_id={r.group_id!r}, read={r.ord if r.section == 2 else None})" for r in rows if r.section > 1)
    spelt = gfa.spelt(graphs, "group_id")
    assert "Join" not in spelt._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, spelt.collect()))
    assert len(got) == sum(r.section > 1 for r in rows)
    monkeypatch.setattr(jvm, "available", lambda spark: False)
    assert got == sorted(map(str, gfa.spelt(graphs, "group_id").collect()))
    if name == "strand":
        whole = lambda df: sorted((r.group_id, r.lines, r.paths) for r in df.collect() if r.lines)
        assert whole(graphs) == whole(poa.graph_lines(known, params, with_consensus))


def test_a_step_without_a_segment_is_marked(spark):
    graphs = spark.createDataFrame([("a", ["S\tx\tAC", "S\ty\tG\tLN:i:1", "H\t"], [(0, "P\tp\tx+,z+,y+\t*"), (None, "P\tq\ty+")])], f"group_id string, {poa.GRAPH_LINES}")
    assert [tuple(r) for r in gfa.spelt(graphs, "group_id").orderBy("path").collect()] == [("a", 0, "p", "AC?G"), ("a", None, "q", "G")]


@pytest.mark.parametrize("name", ["frequent", "strand"])
def test_votes_where_the_rows_are_are_those_of_their_cells(reads, name, monkeypatch):
    result = poa.poa(reads, Params(**SETTINGS[name]), ("msa",)).cache()
    got = columns.voted(result, "n_seq")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, got.collect()))
    monkeypatch.setattr(jvm, "available", lambda spark: False)
    assert got == sorted(map(str, columns.voted(result, "n_seq").collect())) and len(got) == 5


def test_columns_of_gaps_and_unknown_letters_have_no_vote(spark):
    groups = spark.createDataFrame([("a", [(0, "AC-N"), (1, "AG-N"), (2, "-GT-")]), ("b", [])], "group_id string, msa array<struct<read_id:int,aligned:string>>")
    assert [tuple(r) for r in columns.voted(groups).orderBy("group_id").collect()] == [("a", "AG"), ("b", "")]


def test_lines_of_single_reads_are_made_of_those_alone(spark, tmp_path):
    rows = [("one", 0, "x", "ACGT", None, 0), ("two", 0, "y", "ACGT", None, 1), ("two", 1, "z", "ACT", None, 2)]
    spark.createDataFrame(rows, "group_id string, read_id int, name string, seq string, qual string, read_key long").write.parquet(str(tmp_path / "seq_reads.parquet"))
    lines = catalog_graphs.poa_single_reads(spark, str(tmp_path))
    assert "LeftSemi" not in lines._jdf.queryExecution().executedPlan().toString()
    got = lines.collect()
    assert {r.group_id for r in got} == {"one"} and len(got) == 2 + 4 + 1 + 4 + 3 + 1 + 5


@pytest.mark.parametrize("name", ["convex", "quality", "strand", "longest_first"])
def test_kept_graphs_are_those_of_the_numpy_kernels(reads, name, monkeypatch):
    params, key = Params(**SETTINGS[name]), lambda r: (r.group_id is not None, r.group_id or "")
    first, second = reads.where("read_id % 3 < 2"), reads.where("read_id % 3 = 2")

    def states():
        one = incremental.add(None, first, params)
        restored = incremental.from_graph_lines(poa.graph_lines(first.where("group_id is not null"), params), params)
        return [incremental.add(one, second, params), incremental.add(restored, second, params)]

    made = states()
    assert not any("MapInArrow" in x._jdf.queryExecution().executedPlan().toString() for x in made)
    made = [x.cache() for x in made]
    got = [sorted(incremental.finish(x, params).collect(), key=key) for x in made]
    assert got[0] == sorted(incremental.add(incremental.add(None, first, params), second, params, parts=poa.PARTS).collect(), key=key)
    monkeypatch.setattr(jvm, "available", lambda spark: False)
    assert got == [sorted(incremental.finish(x, params).collect(), key=key) for x in made]  # states are read by either kernel
    assert got == [sorted(incremental.finish(x, params).collect(), key=key) for x in states()]


def test_a_packed_state_is_the_same_graph():
    params = Params(use_quality=True, max_consensus=2)
    graph = fold([("ACGTACGT", "IIIIIIII"), ("ACGACGT", None), ("ACTTACGT", "!!!!!!!!")], params).graph
    reads = [{"read_id": None, "name": "é", "is_rc": True, "score": -3}, {"read_id": 7, "name": None, "is_rc": False, "score": 0}, {"read_id": 0, "name": "", "is_rc": False, "score": 9}]
    again, kept = incremental.unpack(incremental.pack(graph, reads))
    assert kept == reads and vars(again) == vars(graph)


def test_lines_of_a_graph_that_do_not_fit_are_an_error(spark):
    for path in ("P\tp\tx+,z+\t*", "P\tp\tx+,x-\t*", "P\tp\t\t*"):
        graphs = spark.createDataFrame([("a", ["S\tx\tAC"], [(0, path)])], f"group_id string, {poa.GRAPH_LINES}")
        with pytest.raises(Exception, match="path 'p'"):
            incremental.from_graph_lines(graphs).collect()
