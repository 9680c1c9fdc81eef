"""Kernels: known results, a scalar alignment to compare with, and what must hold for any reads."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork import fixtures
from braidwork.kernels import restore, seed
from braidwork.kernels.align import align
from braidwork.kernels.consensus import call, phred
from braidwork.kernels.fold import complement, fold, fold_many
from braidwork.kernels.lattice import SINK, SOURCE, Lattice
from braidwork.kernels.params import Params

READS, CONSENSUS = fixtures.NOISY, fixtures.CONSENSUS


def made(seqs, params=Params()):
    return fold([(s, None) for s in seqs], params)


def ungapped(graph, params):
    return [params.decode([b for _, b in sorted(row)]) for row in graph.cells()]


@pytest.mark.parametrize("kind", ["heaviest", "frequent"])
def test_known_consensus(kind):
    p = Params(consensus=kind)
    assert p.decode(call(made(READS, p).graph, p)[0].bases) == CONSENSUS


def test_known_clusters():
    p = Params(max_consensus=2)
    got = call(made(fixtures.ALLELES, p).graph, p)
    assert [(",".join(map(str, c.reads)), p.decode(c.bases)) for c in got] == fixtures.CLUSTERS


def scalar_score(graph, q, p):
    """Global alignment score, cell by cell, without a band."""
    low = -(10**9)
    graph.order()
    s, pieces = p.scores(), p.pieces or None
    H, E = {}, {}
    for x in graph.node_at:
        if x == SINK:
            break
        h, e = [low] * (len(q) + 1), [[low] * (len(q) + 1) for _ in pieces or [0]]
        if x == SOURCE:
            for j in range(len(q) + 1):
                h[j] = 0 if j == 0 else -p.gap_cost(j)
            for k, (oe, _) in enumerate(pieces or []):
                e[k][0] = -oe
            H[x], E[x] = h, e
            continue
        m = [max([H[a][j - 1] for a in graph.into[x]]) + int(s[graph.base[x], q[j - 1]]) if j else low for j in range(len(q) + 1)]
        if pieces is None:
            for j in range(len(q) + 1):
                h[j] = max(m[j], max(H[a][j] for a in graph.into[x]) - p.gap_extend[0], (h[j - 1] - p.gap_extend[0]) if j else low)
            H[x], E[x] = h, e
            continue
        before = [[max(E[a][k][j] for a in graph.into[x]) for j in range(len(q) + 1)] for k in range(len(pieces))]
        f = [low] * len(pieces)
        source = low
        for j in range(len(q) + 1):
            over = max(m[j], *(b[j] for b in before))
            f = [max(source - oe, f[k] - ge) if j else low for k, (oe, ge) in enumerate(pieces)]
            h[j] = max(over, *f)
            for k, (oe, ge) in enumerate(pieces):
                e[k][j] = max(before[k][j] - ge, h[j] - oe)
                if len(pieces) == 1 and f[0] > over:
                    e[k][j] = low
            source = m[j] if len(pieces) == 1 else over
        H[x], E[x] = h, e
    return max(H[a][len(q)] for a in graph.into[SINK])


@pytest.mark.parametrize("opens", [(4, 24), (4, 0), (0, 0)])
def test_scores_equal_scalar(opens):
    p = Params(gap_open=opens, band=-1)
    r = random.Random(1)
    graph = made(READS[:4], p).graph
    for _ in range(4):
        q = p.encode("".join(r.choice("ACGTN") for _ in range(r.randint(1, 40))))
        found = align(graph, q, p)
        assert found.score == scalar_score(graph, q, p)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ACGTN", min_size=1, max_size=30), min_size=1, max_size=6), st.sampled_from([(4, 24), (4, 0), (0, 0)]), st.sampled_from(["global", "local", "extend"]))
def test_graphs_keep_their_reads(seqs, opens, mode):
    p = Params(gap_open=opens, mode=mode)
    graph = made(seqs, p).graph
    assert ungapped(graph, p) == seqs
    assert sum(x.bit_count() for x in graph.out_reads[SOURCE]) == len(seqs)
    at = graph.index
    assert all(at[a] < at[b] for a, b, *_ in graph.edges())
    rank = graph.ranks()
    assert len({(rank[x], graph.base[x]) for x in range(2, len(graph))}) == len(graph) - 2


def test_groups_do_not_touch_one_another():
    r = random.Random(5)
    groups = [["".join(r.choice("ACGTN") for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 5))] for _ in range(70)]
    for p in (Params(), Params(mode="local"), Params(gap_open=(0, 0), path_score=True)):
        together = list(fold_many([([(s, None) for s in g], None) for g in groups], p))
        for g, f in zip(groups, together):
            alone = made(g, p)
            assert list(alone.graph.edges()) == list(f.graph.edges()) and alone.scores == f.scores


def test_banded_score_is_no_higher():
    p = Params()
    graph = made(READS, p).graph
    for q in READS:
        assert align(graph, p.encode(q), Params(band=2)).score <= align(graph, p.encode(q), Params(band=-1)).score


def test_same_reads_give_themselves():
    p = Params()
    assert p.decode(call(made([READS[0]] * 70, p).graph, p)[0].bases) == READS[0]  # more reads than a word has bits


def test_empty_reads_and_groups():
    p = Params()
    assert call(made([], p).graph, p) == [] and call(made(["", ""], p).graph, p) == []
    f = made(["", "ACGT", ""], p)
    assert f.graph.n_seq == 3 and ungapped(f.graph, p) == ["", "ACGT", ""]
    assert ungapped(made(["NNNN", "acgu"], p).graph, p) == ["NNNN", "ACGT"]


def test_strands_order_and_quality():
    back = Params().decode(complement(Params().encode(READS[3])))
    f = made([*READS[:3], back], Params(both_strands=True))
    assert f.reversed == [False, False, False, True] and ungapped(f.graph, Params())[3] == READS[3]
    assert made(["AC", "ACGT", "ACG"], Params(longest_first=True)).order == [1, 2, 0]
    p = Params(use_quality=True)
    g = fold([("ACGT", "IIII"), ("ACGT", "IIII"), ("ACGA", "!!!!")], p).graph
    assert p.decode(call(g, p)[0].bases) == "ACGT"


def test_amino_and_matrix():
    p = Params(amino=True)
    assert (p.k, p.w, p.m) == (7, 4, 27)
    g = made(["MKVLAA", "MKVLA", "MKILAA"], p).graph
    assert p.decode(call(g, p)[0].bases) == "MKVLAA"


def noisy(s, r):
    return "".join(c if (x := r.random()) > 0.08 else "" if x < 0.03 else r.choice("ACGT") if x < 0.05 else c + r.choice("ACGT") for c in s)


@pytest.mark.parametrize("how", [{"seeding": True}, {"progressive": True}, {"seeding": True, "progressive": True}, {"seeding": True, "both_strands": True}])
def test_anchored_fold(how):
    r = random.Random(3)
    truth = "".join(r.choice("ACGT") for _ in range(700))
    seqs = [noisy(truth, r) for _ in range(4)]
    p = Params(k=13, min_window=100, **how)
    if how.get("both_strands"):
        seqs[2], seqs[3] = (p.decode(complement(p.encode(x))) for x in seqs[2:])
    f = made(seqs, p)
    for i, got in enumerate(ungapped(f.graph, p)):
        assert got == (p.decode(complement(p.encode(seqs[i]))) if f.reversed[i] else seqs[i])
    if how.get("both_strands"):
        assert f.reversed == [False, False, True, True]


def test_minimisers_are_window_minima():
    r = random.Random(2)
    p = Params(k=5, w=4)
    codes = np.array([r.randrange(4) for _ in range(200)], np.uint8)
    m = seed.minimisers(codes, p)
    words = [sum(int(c) << 2 * i for i, c in enumerate(reversed(codes[a : a + 5]))) for a in range(196)]
    h = seed.hash_words(np.array(words, np.uint64), 10)
    want = {i + 4 for a in range(193) for i in range(a, a + 4) if h[i] == h[a : a + 4].min()}
    assert set(m.last.tolist()) == want
    assert len(set(seed.hash_words(np.arange(1024, dtype=np.uint64), 10).tolist())) == 1024


def test_chains():
    # what a step adds, number by number
    for dq, dt in ((5, 5), (7, 9), (40, 90), (100, 3)):
        drift = abs(dq - dt)
        assert seed.step_scores(np.array([dq]), np.array([dt]), 19)[0] == int(min(dq, dt, 19) - ((drift.bit_length() - 1 >> 1) + drift * 0.01 * 19))
    r = random.Random(11)
    for _ in range(30):
        found = sorted({(r.randrange(2), r.randrange(300), r.randrange(300)) for _ in range(60)})
        a = np.array(found)
        score, before = seed._linked(a, 19)
        for i, (s, t, q) in enumerate(found):  # brute force over all anchors before
            best = max([19] + [int(score[j]) + int(seed.step_scores(np.array([q - y]), np.array([t - x]), 19)[0]) for j, (z, x, y) in enumerate(found[:i]) if z == s and t - x <= 100 and 0 < q - y <= 100 and abs((q - y) - (t - x)) <= 100])
            assert score[i] == best
        chains = seed._local_chains(score, before)
        assert len({x for c in chains for x in c}) == sum(map(len, chains))
    line = np.array([(0, i, i + 3) for i in range(19, 400, 7)])
    got = seed.chain(line, 19, 60, 420, 420)
    assert got and all(b[1] - a[1] >= 60 and b[2] - a[2] >= 60 for a, b in zip(got, got[1:])) and all(q == t + 3 for _, t, q in got)
    assert seed.chain(np.zeros((0, 3), np.int64), 19, 10, 5, 5) == []
    two = np.array([(0, i, i) for i in range(19, 200, 5)] + [(0, i, i + 150) for i in range(210, 400, 5)])
    got = seed.chain(two, 19, 20, 500, 700)
    assert all(a[1] < b[1] and a[2] < b[2] for a, b in zip(got, got[1:])) and {q - t for _, t, q in got} == {0, 150}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ACGT", min_size=8, max_size=30), min_size=2, max_size=6), st.data())
def test_region_is_closed_and_smallest(seqs, data):
    g = made(seqs).graph
    i = data.draw(st.integers(1, len(g) - 2))
    j = data.draw(st.integers(i, len(g) - 2))
    a, b = (g.index[x] for x in g.region(g.node_at[i], g.node_at[j]))

    def closed(a, b):
        return all(a <= g.index[x] for y in g.node_at[a + 1 : b] for x in g.into[y]) and all(g.index[x] <= b for y in g.node_at[a + 1 : b] for x in g.out[y])

    assert a < i <= j < b and closed(a, b)
    assert not any(closed(c, d) for c in range(a, i) for d in range(j + 1, b + 1) if (c, d) != (a, b))


def test_restore_and_region():
    p = Params()
    rows = [("a", "AC-GT"), ("b", "ACTGT"), ("c_reverse_complement", "AG-G-")]
    got = restore.from_rows(rows, p)
    assert ungapped(got.graph, p) == ["ACGT", "ACTGT", "AGG"] and got.reversed == [False, False, True]
    again = restore.from_paths([("x", "AC"), ("y", "T"), ("z", "GT")], [("1", "x+,z+"), ("2", "x+,y+,z+"), ("3", "z-,x-")], p)
    assert again.graph.out_weight[SOURCE] == [3] and again.reversed == [False, False, True]
    for bad in ([("1", "x+,q+")], [("1", "x+,z-")], [("1", "")]):
        with pytest.raises(ValueError):
            restore.from_paths([("x", "AC"), ("z", "GT")], bad, p)
    with pytest.raises(ValueError):
        restore.from_paths([("x", "A"), ("x", "C")], [], p)
    g = made(READS[:3], p).graph
    a, b = g.region(g.node_at[5], g.node_at[9])
    assert g.index[a] <= 5 and g.index[b] >= 9


def test_part_alignment_leaves_the_rest():
    p = Params(spanning_only=True, consensus="frequent")
    g = made(["ACGTACGTAC"], p).graph
    a, b = g.region(g.node_at[3], g.node_at[7])
    q = p.encode("GTTC")
    steps = align(g, q, p, a, b).steps
    g.n_seq = 2
    g.fuse(q, [1] * 4, steps, 1, a, b, both_ends=False)
    assert ungapped(g, p)[0] == "ACGTACGTAC" and g.n_span[g.node_at[5]] == 2 and g.n_span[SOURCE] == 1


def test_params_and_phred():
    for bad in ({"match": -1}, {"gap_extend": (0, 0)}, {"max_consensus": 11}, {"w": 0}, {"k": 29}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert Params(mode="local").band == -1 and [Params().gap_cost(n) for n in (1, 20, 40)] == [6, 44, 64]
    assert phred(10, 10) > phred(6, 10) > phred(2, 10) >= 33
    with pytest.raises(ValueError):
        phred(3, 2)
    assert list(itertools.chain(Lattice().out[SOURCE])) == []
