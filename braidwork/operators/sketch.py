"""Words, minimisers, and what reads of a group share of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions import sequences as S
from braidwork.kernels import seed
from braidwork.kernels.params import Params
from braidwork.plans.columns import take


def words(reads: DataFrame, keep: list[str], seq: str, k: int) -> DataFrame:
    """(keep, pos, word): every word of k known letters, by its first letter from 0."""
    rows = reads.select(*keep, S.residues(seq).alias("s")).where(F.length("s") >= k)
    at = rows.select(*keep, "s", F.explode(F.sequence(F.lit(0), F.length("s") - k)).alias("pos"))
    return at.select(*keep, "pos", F.substring("s", F.col("pos") + 1, F.lit(k)).alias("word")).where(~F.col("word").contains("N"))


def _sketch(params: Params):
    def batches(it):
        for batch in it:
            found = [seed.minimisers(params.encode(s or ""), params) for s in batch.column("seq").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f.hash) for f in found])
            cat = lambda x, t: pa.array(np.concatenate([getattr(f, x) for f in found]).astype(t) if found else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays([batch.column("group_id").take(pa.array(row)), batch.column("read_id").take(pa.array(row)), cat("hash", np.int64), cat("last", np.int32), cat("strand", np.int8)], names=["group_id", "read_id", "hash", "last", "strand"])

    return batches


def minimisers(reads: DataFrame, params: Params = Params(), group: str = "group_id", read_id: str = "read_id", seq: str = "seq") -> DataFrame:
    """(group_id, read_id, hash, last, strand) of each read's minimisers; no shuffle."""
    rows = take(reads, group_id=F.col(f"`{group}`").cast("string"), read_id=F.col(f"`{read_id}`").cast("int"), seq=seq)
    return rows.mapInArrow(_sketch(params), "group_id string, read_id int, hash long, last int, strand tinyint")


def shared(minis: DataFrame) -> DataFrame:
    """(group_id, i, j, hits), i < j: minimisers two reads share, each as often as both have it."""
    counts = minis.groupBy("group_id", "hash", "read_id").agg(F.count("*").alias("n"))
    a, b = (counts.select("group_id", "hash", F.col("read_id").alias(x), F.col("n").alias("n" + x)) for x in "ij")
    return a.join(b, ["group_id", "hash"]).where("i < j").groupBy("group_id", "i", "j").agg(F.sum(F.least("ni", "nj")).alias("hits"))


def jaccard(minis: DataFrame) -> DataFrame:
    """(group_id, i, j, hits, similarity) of the pairs that share a minimiser; all others have 0."""
    total = minis.groupBy("group_id", "read_id").agg(F.count("*").alias("n"))
    side = lambda x: total.select("group_id", F.col("read_id").alias(x), F.col("n").alias("n" + x))
    both = shared(minis).join(side("i"), ["group_id", "i"]).join(side("j"), ["group_id", "j"])
    return both.select("group_id", "i", "j", "hits", F.round(F.col("hits") / (F.col("ni") + F.col("nj") - F.col("hits")), 6).alias("similarity"))


def first_pair(pairs: DataFrame) -> DataFrame:
    """(group_id, i, j, similarity): the most alike pair, with the smallest j, then i, of equals."""
    best = pairs.groupBy("group_id").agg(F.max_by(F.struct("i", "j", "similarity"), F.struct("similarity", -F.col("j"), -F.col("i"))).alias("x"))
    return best.select("group_id", "x.*")


def anchors(minis: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(group_id, tid, qid, strand, tpos, qpos) of equal minimisers of each read and the one after it."""
    order = Window.partitionBy("group_id").orderBy("read_id")
    after = reads.select("group_id", "read_id", F.length("seq").alias("len")).withColumn("tid", F.lag("read_id").over(order)).where("tid is not null")
    t = minis.select("group_id", F.col("read_id").alias("tid"), "hash", F.col("last").alias("tpos"), F.col("strand").alias("ts"))
    q = minis.join(after, ["group_id", "read_id"]).select("group_id", "tid", F.col("read_id").alias("qid"), "hash", F.col("last").alias("ql"), F.col("strand").alias("qs"), "len")
    both = t.join(q, ["group_id", "tid", "hash"])
    strand = (F.col("ts") != F.col("qs")).cast("int")
    return both.select("group_id", "tid", "qid", strand.alias("strand"), "tpos", F.when(strand == 1, F.col("len") - (F.col("ql") + 1 - k) - 1).otherwise(F.col("ql")).alias("qpos"))


def chain_pairs(found: DataFrame, k: int, reach: int = seed.MAX_STEP, drift: int = seed.MAX_DRIFT) -> DataFrame:
    """Each two anchors of a pair of reads that may follow one another, with what the step scores.

    A band join: anchors fall into tiles of the reach in t, and each is met by
    those of its own tile and the one before.
    """
    tile = lambda df: df.withColumn("tile", F.floor(F.col("tpos") / reach))
    keys = ["group_id", "tid", "qid", "strand"]
    later = tile(found).select(*keys, F.col("tpos").alias("t2"), F.col("qpos").alias("q2"), F.explode(F.array("tile", F.col("tile") - 1)).alias("tile"))
    earlier = tile(found).select(*keys, F.col("tpos").alias("t1"), F.col("qpos").alias("q1"), "tile")
    dt, dq = F.col("t2") - F.col("t1"), F.col("q2") - F.col("q1")
    both = later.join(earlier, [*keys, "tile"]).where((dt >= 0) & (dt <= reach) & (dq > 0) & (dq <= reach) & (F.abs(dq - dt) <= drift) & ((dt > 0) | (F.col("q1") < F.col("q2"))))
    off = F.abs(dq - dt)
    cost = F.floor(S.ilog2(off) / 2) + off * 0.01 * k
    score = (F.least(dq, dt, F.lit(k)) - cost).cast("int")
    return both.select(*keys, "t1", "q1", "t2", "q2", score.alias("score"))
