"""Relational analysis of aligned rows: depths, votes, edges, variable sites, distances and clusters.

Input is one row a read: (group_id, read_id, aligned), ``-`` for gaps, rows of
a group of one length, read_id unique in its group. Letters are exploded once
and aggregated to (group, column, letter) with their reads; a gap's reads are
those of the group that have no letter there, so gaps and padding are never
rows. What has reads in pairs (distances) or in their order (assignment) is
computed group by group on the few variable sites.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions import sequences as S
from braidwork.kernels import jvm
from braidwork.plans.grouping import each_group, grouped
from braidwork.plans.lineage import written

GAP = "-"


def padded(reads: DataFrame) -> DataFrame:
    """Reads as aligned rows: flush left, padded with gaps to the longest of their group."""
    longest = reads.groupBy("group_id").agg(F.max(F.length("seq")).alias("width"))
    rows = reads.select("group_id", "read_id", S.residues("seq").alias("s")).join(longest, "group_id")
    return rows.select("group_id", "read_id", F.rpad("s", F.col("width"), GAP).alias("aligned"))


def all_cells(rows: DataFrame) -> DataFrame:
    """(group_id, read_id, col, base) with gaps."""
    return rows.select("group_id", "read_id", F.posexplode(F.split("aligned", "")).alias("col", "base")).where("base <> ''")


def cells(rows: DataFrame) -> DataFrame:
    return all_cells(rows).where(F.col("base") != GAP)


def depth(rows: DataFrame) -> DataFrame:
    """(group_id, col, base, depth, first_read) of every letter and gap of a column."""
    return all_cells(rows).groupBy("group_id", "col", "base").agg(F.count("*").alias("depth"), F.min("read_id").alias("first_read"))


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group_id").agg(F.count("*").alias("n"))


def votes(rows: DataFrame) -> DataFrame:
    """(group_id, col, base, cov, n): the most frequent known letter of a column, where gaps are not more frequent."""
    known = cells(rows).where(F.col("base").isin("A", "C", "G", "T")).groupBy("group_id", "col", "base").agg(F.count("*").alias("depth"))
    best = known.groupBy("group_id", "col").agg(F.max_by("base", F.struct("depth", -F.ascii("base"))).alias("base"), F.max("depth").alias("cov"), F.sum("depth").alias("total"))
    out = best.join(group_sizes(rows), "group_id")
    return out.where(F.col("cov") >= F.col("n") - F.col("total")).select("group_id", "col", "base", "cov", "n")


def voted_consensus(rows: DataFrame) -> DataFrame:
    """(group_id, seq, len) of the votes of each group."""
    got = votes(rows).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("col", "base"))).alias("x"))
    return got.select("group_id", F.array_join(F.transform("x", lambda s: s.base), "").alias("seq"), F.size("x").cast("long").alias("len"))


def voted(groups: DataFrame, *keep: str) -> DataFrame:
    """(group_id, keep, voted): as ``voted_consensus`` of groups with their rows in one list ``msa``, empty without votes; ``keep`` may be any columns.

    A group's rows are counted where they are, where the JVM can be reached; else by ``voted_consensus`` and a join.
    """
    if jvm.available(groups.sparkSession):
        return groups.select("group_id", *keep, jvm.call(groups, "string", F.col("msa.aligned"), F.lit(""), kernel="Vote").alias("voted"))
    groups = written(groups.withColumn("of", F.to_json(F.struct("group_id"))), "rows")  # no null, for the join
    called = voted_consensus(groups.select(F.col("of").alias("group_id"), F.explode("msa").alias("x")).select("group_id", "x.*"))
    return groups.join(called.select(F.col("group_id").alias("of"), F.col("seq").alias("voted")), "of", "left").select("group_id", *keep, F.coalesce("voted", F.lit("")).alias("voted"))


def steps(rows: DataFrame) -> DataFrame:
    """(group_id, read_id, from_node, to_node): the edges each read takes; a node is its column and letter."""
    order = Window.partitionBy("group_id", "read_id").orderBy("col")
    named = cells(rows).withColumn("node", F.concat(F.col("col").cast("string"), "base"))
    inner = named.select("group_id", "read_id", F.lag("node", 1, "S").over(order).alias("from_node"), F.col("node").alias("to_node"))
    last = named.groupBy("group_id", "read_id").agg(F.max_by("node", "col").alias("from_node")).withColumn("to_node", F.lit("E"))
    return inner.unionByName(last)


def edges(rows: DataFrame) -> DataFrame:
    """(group_id, from_node, to_node, weight)."""
    return steps(rows).groupBy("group_id", "from_node", "to_node").agg(F.count("*").alias("weight"))


def edge_reads(rows: DataFrame) -> DataFrame:
    """(group_id, from_node, to_node, read_ids) with the reads of each edge in order."""
    got = steps(rows).groupBy("group_id", "from_node", "to_node").agg(F.sort_array(F.collect_list("read_id")).alias("r"))
    return got.select("group_id", "from_node", "to_node", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("read_ids"))


def node_weights(edge_table: DataFrame) -> DataFrame:
    return edge_table.groupBy("group_id", F.col("from_node").alias("node")).agg(F.sum("weight").alias("weight"))


def path_scores(edge_table: DataFrame) -> DataFrame:
    """(group_id, from_node, to_node, score) of every edge."""
    whole = node_weights(edge_table).select("group_id", F.col("node").alias("from_node"), F.col("weight").alias("total"))
    return edge_table.join(whole, ["group_id", "from_node"]).select("group_id", "from_node", "to_node", S.path_score("weight", "total").cast("long").alias("score"))


def cluster_cover(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(group_id, cluster, node, cov): reads of a cluster that pass a node."""
    passing = steps(rows).where("from_node <> 'S'").join(clusters, ["group_id", "read_id"])
    return passing.groupBy("group_id", "cluster", F.col("from_node").alias("node")).agg(F.count("*").alias("cov"))


def _least(n: Column, freq: float) -> Column:
    least = F.greatest(F.lit(2), F.ceil(n * freq))
    return F.greatest(F.lit(2), F.floor(least / 2))


def site_table(rows: DataFrame, freq: float = 0.25) -> DataFrame:
    """(group_id, col, alleles): columns with two or more alleles that enough reads have and enough lack.

    alleles: (first_read, base, depth, reads) of those, by their first read.
    """
    letters = cells(rows).groupBy("group_id", "col", "base").agg(F.count("*").alias("depth"), F.min("read_id").alias("first_read"), F.collect_list("read_id").alias("reads"))
    per = letters.groupBy("group_id", "col").agg(F.collect_list(F.struct("first_read", "base", "depth", "reads")).alias("x"), F.sum("depth").alias("total"))
    n, least = F.col("n"), _least(F.col("n"), freq)
    enough = lambda d: (d >= least) & (d <= n - least)
    groups = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.collect_list("read_id").alias("everyone"))
    per = per.join(groups, "group_id").where(F.size(F.filter("x", lambda a: enough(a.depth))) + enough(n - F.col("total")).cast("int") >= 2)
    known = F.filter(F.transform("x", lambda a: a.withField("reads", F.sort_array(a.reads))), lambda a: enough(a.depth))
    gap_reads = F.sort_array(F.array_except("everyone", F.flatten(F.transform("x", lambda a: a.reads))))
    gap = F.struct(gap_reads[0].alias("first_read"), F.lit(GAP).alias("base"), (n - F.col("total")).alias("depth"), gap_reads.alias("reads"))
    return per.select("group_id", "col", F.sort_array(F.when(enough(n - F.col("total")), F.concat(known, F.array(gap))).otherwise(known)).alias("alleles"))


def _summary(alleles: str = "alleles") -> tuple[Column, Column]:
    depth_ = F.aggregate(F.transform(alleles, lambda a: a.depth), F.lit(0).cast("long"), lambda x, d: x + d)
    return depth_.alias("depth"), F.exists(alleles, lambda a: a.base == GAP).cast("int").alias("var_type")


def sites(rows: DataFrame, freq: float = 0.25) -> DataFrame:
    """(group_id, col, depth, var_type, alleles): 0 for letters alone, 1 with a gap; alleles by their first read."""
    return site_table(rows, freq).select("group_id", "col", *_summary(), F.array_join(F.transform("alleles", lambda a: a.base), "").alias("alleles"))


def _profiles(rows: DataFrame, freq: float) -> DataFrame:
    """One row a site, with the reads of each allele by its first read, and their letters in the first column."""
    rows_ = site_table(rows, freq).select("group_id", "col", *_summary(), F.transform("alleles", lambda a: a.reads).alias("reads"), F.transform("alleles", lambda a: a.base).alias("bases"))
    first = F.min_by(F.struct("depth", "bases"), "col").alias("f")
    got = rows_.groupBy("group_id", "reads").agg(F.min("col").alias("site"), F.count("*").alias("count"), F.min("var_type").alias("var_type"), first)
    return got.select("group_id", "site", "count", F.col("f.depth").alias("depth"), "var_type", "reads", F.col("f.bases").alias("bases"))


def profiles(rows: DataFrame, freq: float = 0.25) -> DataFrame:
    """(group_id, site, count, depth, var_type): columns that part the reads alike, as one site, named by the first."""
    return _profiles(rows, freq).select("group_id", "site", "count", "depth", "var_type")


def priorities(profile_table: DataFrame) -> DataFrame:
    """Sites with their rank within the group: most columns, then depth, then letters before gaps, then the first."""
    w = Window.partitionBy("group_id").orderBy(F.desc("count"), F.desc("depth"), "var_type", "site")
    return profile_table.withColumn("priority", F.row_number().over(w).cast("long"))


def _weight() -> Column:
    return F.col("count") * F.when(F.col("var_type") == 0, 2).otherwise(1)


def site_alleles(rows: DataFrame, freq: float = 0.25) -> DataFrame:
    """(group_id, site, read_id, base, weight): each read's allele at each site."""
    each = _profiles(rows, freq).select("group_id", "site", _weight().alias("weight"), F.explode(F.arrays_zip("bases", "reads")).alias("a"))
    return each.select("group_id", "site", F.explode("a.reads").alias("read_id"), F.col("a.bases").alias("base"), "weight")


_PAIRS = pa.schema([("group_id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("dis", pa.int64())])


def _pairs(batches):
    """Distances of a group's reads from its sites, some rows of the matrix at a time."""
    for name, c in each_group(batches, "group_id"):
        reads = np.unique(np.concatenate([np.array(r, np.int32) for alleles in c["reads"] for r in alleles]))
        of = np.full((len(c["site"]), len(reads)), -1, np.int8 if max(map(len, c["reads"])) < 127 else np.int16)
        for row, alleles in zip(of, c["reads"]):
            for n, r in enumerate(alleles):
                row[np.searchsorted(reads, r)] = n
        step = max(1, (1 << 22) // max(1, len(reads)))
        for low in range(0, len(reads), step):
            part = of[:, low : low + step]
            d = np.zeros((part.shape[1], len(reads)), np.int64)
            for row, mine, weight in zip(of, part, c["weight"]):
                d += weight * ((mine[:, None] != row[None, :]) & (mine[:, None] >= 0) & (row[None, :] >= 0))
            i, j = np.nonzero(np.triu(d, low + 1))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(reads[i + low]), pa.array(reads[j]), pa.array(d[i, j])], schema=_PAIRS)


def distances(rows: DataFrame, freq: float = 0.25) -> DataFrame:
    """(group_id, i, j, dis), i < j, of reads that differ at a site; all others are at 0."""
    table = _profiles(rows, freq).select("group_id", "site", _weight().alias("weight"), "reads")
    return grouped(table, "group_id", "site").mapInArrow(_pairs, "group_id string, i int, j int, dis long")


def farthest(rows: DataFrame, distance_table: DataFrame, freq: float = 0.25) -> DataFrame:
    """(group_id, i, j, dis): of the reads with different alleles at the group's first site by priority the two farthest apart.

    Of equals the first by alleles, then by reads; i has the allele that comes first.
    """
    best = _profiles(rows, freq).groupBy("group_id").agg(F.max_by("reads", F.struct("count", "depth", -F.col("var_type"), -F.col("site"))).alias("reads"))
    at = best.select("group_id", F.posexplode("reads").alias("allele", "r")).select("group_id", "allele", F.explode("r").alias("read"))
    side = lambda x: at.select("group_id", F.col("read").alias(x), F.col("allele").alias("a" + x))
    met = distance_table.join(side("i"), ["group_id", "i"]).join(side("j"), ["group_id", "j"]).where("ai <> aj")
    turned = F.when(F.col("ai") < F.col("aj"), F.struct("ai", "aj", "i", "j")).otherwise(F.struct(F.col("aj").alias("ai"), F.col("ai").alias("aj"), F.col("j").alias("i"), F.col("i").alias("j")))
    got = met.select("group_id", "dis", turned.alias("t")).groupBy("group_id").agg(F.min(F.struct((-F.col("dis")).alias("far"), "t")).alias("x"))
    return got.select("group_id", F.col("x.t.i").alias("i"), F.col("x.t.j").alias("j"), (-F.col("x.far")).alias("dis"))


def _smaller(di: list, dj: list) -> list[int]:
    """The nearer of two for each read; of equals the cluster that is smaller so far, else the second."""
    out, sizes = [], [0, 0]
    for a, b in zip(di, dj):
        out.append(int(b < a) if a != b else int(sizes[0] >= sizes[1]))
        sizes[out[-1]] += 1
    return out


def _nearer(batches):
    for name, c in each_group(batches, "group_id"):
        out = _smaller(c["di"], c["dj"])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array(c["read_id"], pa.int32()), pa.array(out, pa.int32())], names=["group_id", "read_id", "cluster"])


def assign(rows: DataFrame, distance_table: DataFrame, medoids: DataFrame) -> DataFrame:
    """(group_id, read_id, cluster): the nearer of the group's two medoids (i: 0, j: 1).

    A tie goes to the cluster that is smaller so far, in the order of reads, and
    to 1 if both are of one size; so a group's reads are gone through in order.
    """
    both = distance_table.select("group_id", F.col("i").alias("a"), F.col("j").alias("b"), "dis")
    both = both.unionByName(both.select("group_id", F.col("b").alias("a"), F.col("a").alias("b"), "dis"))
    to = lambda x: both.select("group_id", F.col("a").alias("read_id"), F.col("b").alias(x), F.col("dis").alias("d" + x))
    m = medoids.select("group_id", "i", "j")
    out = rows.select("group_id", "read_id").join(m, "group_id").join(to("i"), ["group_id", "read_id", "i"], "left").join(to("j"), ["group_id", "read_id", "j"], "left").na.fill(0, ["di", "dj"])
    return grouped(out.select("group_id", "read_id", "di", "dj"), "group_id", "read_id").mapInArrow(_nearer, "group_id string, read_id int, cluster int")


def medoids(distance_table: DataFrame, clusters: DataFrame) -> DataFrame:
    """(group_id, cluster, medoid, total): the read of a cluster with the least sum of distances within it, the first of equals."""
    both = distance_table.select("group_id", F.col("i").alias("a"), F.col("j").alias("b"), "dis")
    both = both.unionByName(both.select("group_id", F.col("b").alias("a"), F.col("a").alias("b"), "dis"))
    a = clusters.select("group_id", F.col("read_id").alias("a"), F.col("cluster").alias("ca"))
    b = clusters.select("group_id", F.col("read_id").alias("b"), F.col("cluster").alias("cb"))
    inside = both.join(a, ["group_id", "a"]).join(b, ["group_id", "b"]).where("ca = cb").groupBy("group_id", "a").agg(F.sum("dis").alias("total"))
    all_ = clusters.select("group_id", F.col("read_id").alias("a"), "cluster").join(inside, ["group_id", "a"], "left").na.fill(0, ["total"])
    best = all_.groupBy("group_id", "cluster").agg(F.min(F.struct("total", "a")).alias("x"))
    return best.select("group_id", "cluster", F.col("x.a").alias("medoid"), F.col("x.total").alias("total"))


def _letters(aligned: list[str]) -> np.ndarray:
    """Reads by columns, one code a letter; a row that is shorter than the longest ends in gaps."""
    wide = max(1, max(map(len, aligned)))
    if all(map(str.isascii, aligned)):
        out = np.array([a.encode() for a in aligned], f"S{wide}").view(np.uint8).reshape(len(aligned), wide)
    else:
        out = np.array(aligned, f"U{wide}").view(np.uint32).reshape(len(aligned), wide)
    out[out == 0] = ord(GAP)
    return out


def _labels(m: np.ndarray, freq: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The sites of ``profiles`` of one group: each read's allele at each (or -1), their weights, and the first by priority."""
    n = len(m)
    least = max(2, max(2, math.ceil(n * freq)) // 2)
    kinds = np.unique(m)
    depth = np.array([(m == x).sum(0) for x in kinds])
    kept = (depth >= least) & (depth <= n - least)
    at = np.flatnonzero(kept.sum(0) >= 2)
    if not len(at):
        return np.zeros((n, 0), np.int8), np.zeros(0), -1
    m, depth, kept = m[:, at], depth[:, at], kept[:, at]
    first = np.array([np.where(k, (m == x).argmax(0), n) for x, k in zip(kinds, kept)])
    nth = first.argsort(0, kind="stable").argsort(0, kind="stable")  # place of each allele by its first read
    of = np.full(m.shape, -1, np.int8 if len(kinds) < 128 else np.int32)
    for x, k, place in zip(kinds, kept, nth.astype(of.dtype)):
        np.copyto(of, place, where=(m == x) & k)
    gap = np.zeros(len(at), bool) if ord(GAP) not in kinds else kept[np.searchsorted(kinds, ord(GAP))]
    rows = np.ascontiguousarray(of.T)
    _, site, profile, count = np.unique(rows.view(np.dtype((np.void, n * rows.itemsize))).ravel(), return_index=True, return_inverse=True, return_counts=True)
    only_gaps = np.bincount(profile.ravel(), ~gap, len(site)) == 0
    best = int(np.lexsort((site, only_gaps, -np.where(kept, depth, 0).sum(0)[site], -count))[0])
    return of[:, site], np.where(only_gaps, count, 2 * count).astype(np.float64), best


def _apart(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Distances of some reads from others; whole numbers, far below what a float holds exactly."""
    out = ((x >= 0) * weight) @ (y >= 0).T.astype(np.float64)
    for a in range(int(x.max(initial=-1)) + 1):
        out -= ((x == a) * weight) @ (y == a).T.astype(np.float64)
    return out


_PART = 2048  # reads compared with as many at a time


def _two(of: np.ndarray, weight: np.ndarray, best: int) -> tuple[int, int]:
    """The pair of ``farthest``."""
    parts = [np.flatnonzero(of[:, best] == a) for a in range(int(of[:, best].max()) + 1)]
    top, pick = -1.0, (0, 0)
    for nth, mine in enumerate(parts):
        for other in parts[nth + 1 :]:
            for low in range(0, len(mine), _PART):
                x = mine[low : low + _PART]
                cut = [other[k : k + _PART] for k in range(0, len(other), _PART)]
                tops, ends = np.full(len(x), -1.0), np.zeros(len(x), np.int64)
                for y in cut:
                    d = _apart(of[x], of[y], weight)
                    j = d.argmax(1)
                    d = d[np.arange(len(x)), j]
                    ends[d > tops] = y[j][d > tops]
                    np.maximum(tops, d, out=tops)
                i = int(tops.argmax())
                if tops[i] > top:
                    top, pick = tops[i], (int(x[i]), int(ends[i]))
    return pick


def _sums(of: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sum of each read's distances from all."""
    some, out = (of >= 0).sum(0), np.zeros(len(of))
    for a in range(int(of.max()) + 1):
        lacking = weight * (some - (of == a).sum(0))
        for low in range(0, len(of), _PART):
            out[low : low + _PART] += (of[low : low + _PART] == a) @ lacking
    return out


def _two_clusters(freq: float, give: str):
    def run(batches):
        for name, c in each_group(batches, "group_id"):
            m, ids = _letters(c["aligned"]), c["read_id"]
            of, weight, best = _labels(m, freq)
            if best < 0:
                continue
            i, j = _two(of, weight, best)
            di, dj = np.concatenate([_apart(of[k : k + _PART], of[[i, j]], weight) for k in range(0, len(of), _PART)]).T
            to = np.array(_smaller(di.tolist(), dj.tolist()), np.int32)
            if give == "reads":
                out = [pa.array(ids, pa.int32()), pa.array(to)]
            else:
                members = [np.flatnonzero(to == x) for x in (0, 1)]
                if give == "medoids":
                    totals = [_sums(of[x], weight) for x in members]
                    least = [int(t.argmin()) for t in totals]
                    out = [pa.array([0, 1], pa.int32()), pa.array([ids[x[k]] for x, k in zip(members, least)], pa.int32()), pa.array([int(t[k]) for t, k in zip(totals, least)], pa.int64())]
                else:
                    got: tuple[list, list, list] = ([], [], [])
                    for x, reads in enumerate(members):
                        mine = m[reads]
                        for letter in np.unique(mine):
                            if letter != ord(GAP):
                                cov = (mine == letter).sum(0)
                                at = np.flatnonzero(cov)
                                got[0].append(np.full(len(at), x, np.int32))
                                got[1].extend([f"{k}{chr(letter)}" for k in at.tolist()])
                                got[2].append(cov[at])
                    out = [pa.array(np.concatenate([*got[0], np.zeros(0, np.int32)])), pa.array(got[1], pa.string()), pa.array(np.concatenate([*got[2], np.zeros(0, np.int64)]), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(out[0]), pa.string()), *out], names=["group_id", *(x.split()[0] for x in _GIVEN[give].split(", "))])

    return run


#: Columns of each result behind the group.
_GIVEN = {"reads": "read_id int, cluster int", "medoids": "cluster int, medoid int, total long", "cover": "cluster int, node string, cov long"}


def two_clusters(rows: DataFrame, give: str = "reads", freq: float = 0.25) -> DataFrame:
    """``assign``, ``medoids`` or ``cluster_cover`` (``give``: reads, medoids, cover) of the reads of each group around its two farthest.

    The whole way from rows to clusters in one pass over a group, after one
    shuffle; no pairs of reads are written. A row that is shorter than the
    longest of its group ends in gaps.
    """
    kept = rows.select("group_id", "read_id", "aligned")
    return grouped(kept, "group_id", "read_id").mapInArrow(_two_clusters(freq, give), f"group_id string, {_GIVEN[give]}")


def rows_of(cell_table: DataFrame, widths: DataFrame) -> DataFrame:
    """(group_id, read_id, aligned) from cells without gaps and (group_id, width)."""
    got = cell_table.groupBy("group_id", "read_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "base"))).alias("m")).join(widths, "group_id")
    line = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at(F.col("m"), c.cast("int")), F.lit(GAP)))
    return got.select("group_id", "read_id", F.array_join(line, "").alias("aligned"))
