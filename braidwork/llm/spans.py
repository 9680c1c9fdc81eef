"""Long exact spans shared between records, by super-k-mer partitioning.

Every window of ``width`` letters has a minimiser: the smallest hash of its
32-letter words. Consecutive windows with the same minimiser travel as one
packed string (two bits a letter) to the minimiser's bucket; equal windows
always meet there, and sorting the windows of a bucket finds those that stand
in more than one record. Runs of such windows come back as spans.

Skew: exact copies of a record are collapsed first, with partial aggregation,
and take their class's spans at the end. A minimiser that holds more super-
k-mers than HOT is salted by their places: windows met within one salt are settled
there, and one row per distinct window and salt goes to a second round, which
groups by the window itself.

Defined results: null and empty records, and those shorter than a window, have
no span; windows that hold any letter but A, C, G, T/U are left out; copies of
a record are records like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.residues import Packed, mix, pieces, valid
from braidwork.plans.columns import take
from braidwork.plans.lineage import written

WORD = 32
HOT = 50_000
_RUN = 256  # windows in one super-k-mer at most
_PIECE = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_LETTERS = np.array([[b >> s & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)
_TRAVEL = "mini long, key long, place long, letters binary"  # place: start << 10 | windows << 1 | whether the record has copies
_FOUND = "key long, lo long, hi long, a long, b long, c long, shared boolean"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _super_kmers(width: int):
    def one(row, first, codes, starts, key, many):
        codes = np.append(codes, np.full(4, 4, np.uint8))
        at = np.flatnonzero(valid(codes, width))
        if not len(at):
            return None
        packed, word = Packed(codes), min(WORD, width)
        mini = _sliding_min(mix(packed[word]), width - word + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (mini[1:] != mini[:-1])
        begin = np.flatnonzero(new)
        new |= (np.arange(len(at)) - begin[np.cumsum(new) - 1]) % _RUN == 0
        begin = np.flatnonzero(new)
        windows = np.diff(np.append(begin, len(at)))
        start = at[begin]
        width4 = (windows + width - 1 + 3) // 4
        ends = np.cumsum(width4)
        inner = np.arange(ends[-1]) - np.repeat(ends - width4, width4)
        letters = packed[4][np.repeat(start, width4) + 4 * inner].astype(np.uint8)
        r = np.searchsorted(starts, start, side="right") - 1
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(mini[begin].view(np.int64)), pa.array(key[row[r]]), pa.array((start - starts[r] + first[r]) << 10 | windows << 1 | many[row[r]]),
             pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])],
            names=["mini", "key", "place", "letters"],
        )

    def batches(it):
        for batch in it:
            key, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "many"))
            for piece in pieces(batch.column("seq"), _PIECE, width - 1):
                if (out := one(*piece, key, many)) is not None:
                    yield out

    return batches


def _window_words(packed: Packed, start: np.ndarray, width: int) -> list[np.ndarray]:
    """Three numbers that stand for a window: its letters up to 96 of them, above that its first 32 and two hashes of all others."""
    word = min(WORD, width)
    words = [packed[word][start + i] for i in [*range(0, width - word, word), width - word]]
    if len(words) > 3:
        one = two = np.zeros(len(start), np.uint64)
        for x in words[1:]:
            one, two = mix(one * _ODD[0] + x), mix((two ^ x) * _ODD[1] + x)
        words = [words[0], one, two]
    return words + [np.zeros(len(start), np.uint64)] * (3 - len(words))


def _find(width: int):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        mini, key, place = (t.column(c).to_numpy() for c in ("mini", "key", "place"))
        at, n, many = place >> 10, place >> 1 & 511, (place & 1).astype(bool)
        hot = t.column("hot").to_numpy() if "hot" in t.column_names else np.zeros(len(mini), bool)
        # A minimiser seen in one record only can hold no shared window.
        first = np.flatnonzero(np.concatenate(([True], mini[1:] != mini[:-1])))
        one = (np.minimum.reduceat(key, first) == np.maximum.reduceat(key, first)) & ~np.logical_or.reduceat(many | hot, first)
        keep = np.flatnonzero(~np.repeat(one, np.diff(np.append(first, len(mini)))))
        if not len(keep):
            return None
        key, at, many, n, hot = key[keep], at[keep], many[keep], n[keep], hot[keep]
        letters = t.column("letters").combine_chunks().take(pa.array(keep))
        letters = letters.combine_chunks() if isinstance(letters, pa.ChunkedArray) else letters
        off = np.frombuffer(letters.buffers()[1], np.int32)[letters.offset : letters.offset + len(letters) + 1].astype(np.int64)
        codes = _LETTERS[np.frombuffer(letters.buffers()[2], np.uint8)[off[0] : off[-1]]].reshape(-1)
        base = 4 * (off[:-1] - off[0])
        skm = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(skm)) - np.repeat(np.cumsum(n) - n, n)
        start = base[skm] + inner
        a, b, c = _window_words(Packed(codes), start, width)
        mark = mix(a ^ mix(b + mix(c)))
        order = np.argsort(mark)
        ma, mb, mc = a[order], b[order], c[order]
        same = mark[order][1:] == mark[order][:-1]
        equal = (ma[1:] == ma[:-1]) & (mb[1:] == mb[:-1]) & (mc[1:] == mc[:-1])
        if np.any(same & ~equal):  # two windows with one hash: sort by the windows themselves
            order = np.lexsort((c, b, a))
            ma, mb, mc = a[order], b[order], c[order]
            equal = (ma[1:] == ma[:-1]) & (mb[1:] == mb[:-1]) & (mc[1:] == mc[:-1])
        group = np.flatnonzero(np.concatenate(([True], ~equal)))
        who = key[skm][order]
        met = (np.minimum.reduceat(who, group) != np.maximum.reduceat(who, group)) | np.logical_or.reduceat(many[skm][order], group)
        shared = np.empty(len(order), bool)
        shared[order] = np.repeat(met, np.diff(np.append(group, len(order))))
        run = shared & np.concatenate(([True], ~shared[:-1] | (skm[1:] != skm[:-1])))
        lo = np.flatnonzero(run)
        stop = shared & np.concatenate((~shared[1:] | (skm[1:] != skm[:-1]), [True]))
        hi = np.flatnonzero(stop)
        rows = [(key[skm[lo]], at[skm[lo]] + inner[lo], at[skm[hi]] + inner[hi] + width, None, None, None, np.ones(len(lo), bool))]
        if hot.any():  # one row a distinct window: the first of its group
            pick = order[group][hot[skm[order[group]]]]
            rows.append((key[skm[pick]], at[skm[pick]] + inner[pick], at[skm[pick]] + inner[pick] + width, a[pick].view(np.int64), b[pick].view(np.int64), c[pick].view(np.int64), shared[pick]))
            # the other places of an unshared window are in the same record
            lone = order[~shared[order]]
            lone = lone[hot[skm[lone]] & ~np.isin(lone, pick)]
            rows.append((key[skm[lone]], at[skm[lone]] + inner[lone], at[skm[lone]] + inner[lone] + width, a[lone].view(np.int64), b[lone].view(np.int64), c[lone].view(np.int64), np.zeros(len(lone), bool)))
        out = []
        for k, l, h, x, y, z, s in rows:
            words = [pa.nulls(len(k), pa.int64()) if w is None else pa.array(w) for w in (x, y, z)]
            out.append(pa.RecordBatch.from_arrays([pa.array(k), pa.array(l), pa.array(h), *words, pa.array(s)], names=["key", "lo", "hi", "a", "b", "c", "shared"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()

    def batches(it):
        held: list[pa.RecordBatch] = []
        for batch in it:
            if batch.num_rows == 0:
                continue
            mini = batch.column("mini").to_numpy()
            last = int(np.searchsorted(mini, mini[-1]))
            if held and held[-1].column("mini")[-1].as_py() != mini[0] or last > 0:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, last)])) or ()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from work(pa.Table.from_batches(held)) or ()

    return batches


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of a record that overlap or touch, joined."""
    w = Window.partitionBy("key").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    stepped = spans.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    return stepped.withColumn("nth", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("nth")


def shared_spans(df: DataFrame, key: str, seq: str, width: int = 80, hot: int = HOT) -> DataFrame:
    """(key, span_start, span_end) of each longest stretch covered by windows that stand in another row too.

    ``key`` is a unique integer; rows without one are left out. Windows above 96
    letters are compared by their first 32 letters and 128 bits of hashes.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    spark = df.sparkSession
    reads = take(df, key=F.col(f"`{key}`").cast("long"), seq=seq).where(F.col("key").isNotNull() & (F.length("seq") >= width))
    # The same letters in capitals, other characters as N.
    reads = reads.withColumn("seq", F.regexp_replace(F.translate("seq", "acgtuU", "ACGTTT"), "[^ACGT]", "N"))
    digests = written(reads.select("key", F.unhex(F.md5("seq")).alias("digest")), "digests")
    heads = digests.groupBy("digest").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    # of rows that have copies: the one that stands for them, for all
    roles = written(digests.join(heads, "digest").select("key", "head"), "copies")
    classes = reads.join(roles, "key", "left").where("head is null or head = key").select("seq", "key", F.col("head").isNotNull().alias("many"))
    travel = written(classes.mapInArrow(_super_kmers(width), _TRAVEL), "superkmers")
    total = travel.count()
    crowded = written(travel.groupBy("mini").count().where(F.col("count") > hot).select("mini", F.ceil(F.col("count") / hot).cast("long").alias("salts")), "crowded")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 250_000 + 1)
    by, salted = ["mini"], bool(crowded.head(1))
    if salted:
        travel = travel.join(crowded, "mini", "left")
        travel = travel.select("mini", "key", "place", "letters", F.col("salts").isNotNull().alias("hot"), F.coalesce(F.pmod(F.xxhash64("key", "place"), "salts"), F.lit(0)).cast("long").alias("salt"))
        by = ["mini", "salt"]
    met = travel.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(_find(width), _FOUND)
    if salted:
        met = written(met, "windows")
        again = met.where("a is not null")
        twice = again.groupBy("a", "b", "c").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("shared").alias("any")).where("low <> high or any").select("a", "b", "c")
        late = again.where("not shared").join(twice, ["a", "b", "c"])
        spans = met.where("a is null").select("key", "lo", "hi").unionByName(late.select("key", "lo", "hi"))
    else:
        spans = met.select("key", "lo", "hi")
    spans = _merged(spans)
    # Copies have the spans of the record that stood for them.
    members = roles.select(F.col("head").alias("key"), F.col("key").alias("member"))
    out = spans.join(members, "key", "left").select(F.coalesce("member", "key").alias("key"), "lo", "hi")
    return out.select(F.col("key").alias(key), F.col("lo").alias("span_start"), F.col("hi").alias("span_end"))


def shared_cover(df: DataFrame, key: str, seq: str, width: int = 80) -> DataFrame:
    """(key, n_letters, n_spans, shared_letters, shared_part) of every row with a key; null n_letters counts as 0."""
    spans = shared_spans(df, key, seq, width)
    totals = spans.groupBy(key).agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_letters"))
    rows = take(df, **{key: F.col(f"`{key}`").cast("long"), "n_letters": F.coalesce(F.length(F.col(f"`{seq}`")), F.lit(0)).cast("long")}).where(F.col(key).isNotNull())
    out = rows.join(totals, key, "left").na.fill(0, ["n_spans", "shared_letters"])
    return out.withColumn("shared_part", F.when(F.col("n_letters") > 0, F.round(F.col("shared_letters") / F.col("n_letters"), 6)).otherwise(F.lit(0.0)))
