"""Near-duplicate records by anchor points that cover the collection.

The space is that of sets under Jaccard distance, which is a metric. Anchors
are chosen among the records so that each record has one within RADIUS (most
are their own); every record is replicated to all anchors within RADIUS +
(1 - threshold), and each record is compared only with the others at its own
anchor. By the triangle inequality that meets every pair within the threshold.

Which records may lie within an anchor's reach is read from minwise symbols:
a record has BANDS bands, and two records meet in a bucket if a band agrees.
Two bands must agree for partners. For guests of an anchor one is enough, and
their distance to it is computed: only those within reach are replicated to it.
Pairs that met are always compared exactly, on the sets themselves.

A code over the bits of a Hamming fingerprint was not used: at a similarity of
0.6 one-bit minwise fingerprints differ in a fifth of their bits, so the reach
(covering radius plus threshold) takes in most of the code.

Records with equal sets are one class with one representative, so copies cost
one partial aggregation. A record that has a near anchor leaves the anchor side,
so a crowd around one text meets in linear time; a bucket in which many records
without a near anchor meet is split by second bands (``_thinned``), so a stretch
that all records have in common joins none of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.residues import Packed, encode, mix, pieces, raw_bytes, reverse_complement16, valid
from braidwork.plans.columns import take
from braidwork.plans.lineage import written

RADIUS = 0.1
HOT = 1000  # records that are their own anchor, from which a bucket is split by second bands
_PIECE = 2_000_000
_EMPTY = np.uint64(0xFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = "key long, set_id binary, size int, bands array<long>, payload binary"
_FIVE = np.array([[b // 25 % 5, b // 5 % 5, b % 5] for b in range(125)], np.uint8)


# Sets of canonical words of a sequence ------------------------------------------------

WORD = 16


def _words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted distinct (row << 32 | canonical 16-letter word)."""
    word = Packed(codes)[WORD].astype(np.uint32)
    at = np.flatnonzero(valid(codes, WORD))
    word = word[at]
    word = np.minimum(word, reverse_complement16(word))
    row = np.searchsorted(starts, at, side="right").astype(np.uint64) - np.uint64(1)
    both = (row << np.uint64(32)) | word
    both.sort()
    return both[np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]]


def _word_sets(column: pa.Array):
    """(row numbers, (place << 32 | word)) for some rows at a time, whole rows only."""
    held: list[np.ndarray] = []
    at, n = -1, 0
    for row, first, codes, starts in pieces(column, _PIECE, WORD - 1):
        words = _words(codes, starts)
        if held and row[0] != at:
            yield np.array([at]), np.unique(np.concatenate(held))
            held = []
        if len(row) == 1:
            at, n = row[0], n + 1
            held.append(words)
        else:
            yield row, words
    if held:
        yield np.array([at]), np.unique(np.concatenate(held))


def _pack_letters(column: pa.Array) -> pa.Array:
    """Residue codes, three a byte."""
    raw, off = raw_bytes(column)
    codes, starts = encode(raw, off)
    lens = np.diff(off)
    size = (lens + 2) // 3
    ends = np.concatenate(([0], np.cumsum(size)))
    flat = np.full(3 * ends[-1], 4, np.uint8)
    row = np.repeat(np.arange(len(lens)), lens)
    inner = np.arange(len(raw)) - off[row]
    flat[3 * ends[row] + inner] = codes[starts[row] + inner]
    packed = (flat.reshape(-1, 3) * np.array([25, 5, 1], np.uint8)).sum(1, dtype=np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())


def _letters_payload(column: pa.Array) -> np.ndarray:
    """The sets behind packed letters, as (row << 32 | word)."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    codes = _FIVE[np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]].reshape(-1)
    lens = 3 * np.diff(off)
    ends = np.cumsum(lens)
    # a stop after each row
    row = np.repeat(np.arange(len(lens)), lens)
    flat = np.full(len(codes) + len(lens), 4, np.uint8)
    flat[np.arange(len(codes)) + row] = codes
    return _words(flat, ends - lens + np.arange(len(lens)))


def _band_hash(symbols: np.ndarray) -> np.ndarray:
    """(rows, bands, symbols a band) to (rows, bands): one number a band and its symbols."""
    out = np.zeros(symbols.shape[:2], np.uint64) + np.arange(symbols.shape[1], dtype=np.uint64) * _GOLDEN
    for i in range(symbols.shape[2]):
        out = mix(out + symbols[:, :, i])
    return out


def _list(rows: np.ndarray) -> pa.Array:
    n, m = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def _sketch_words(bands: int, per_band: int, least: int):
    bins = bands * per_band

    def batches(it):
        for batch in it:
            key, seq = batch.column("key"), batch.column("seq")
            for row, both in _word_sets(seq):
                at = (both >> np.uint64(32)).astype(np.int64)
                size = np.bincount(at, minlength=len(row))
                ok = np.flatnonzero(size >= least)
                if not len(ok):
                    continue
                word = both & _EMPTY
                h = mix(word + _GOLDEN)
                symbol = np.full(len(row) * bins, _EMPTY, np.uint64)
                np.minimum.at(symbol, at * bins + ((h >> np.uint64(32)) % np.uint64(bins)).astype(np.int64), h & _EMPTY)
                symbol = symbol.reshape(len(row), bands, per_band)[ok]
                word, ends = word.astype("<u4"), np.concatenate(([0], np.cumsum(size)))
                ids = [hashlib.blake2b(word[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() for i in ok]
                chosen = pa.array(row[ok])
                yield pa.RecordBatch.from_arrays(
                    [key.take(chosen), pa.array(ids, pa.binary()), pa.array(size[ok].astype(np.int32)), _list(_band_hash(symbol)), _pack_letters(seq.take(chosen))],
                    names=["key", "set_id", "size", "bands", "payload"],
                )

    return batches


# Sets of integers within a group ------------------------------------------------------


def _sketch_lists(bands: int, per_band: int, least: int):
    salts = mix(np.arange(1, bands * per_band + 1, dtype=np.uint64) * _GOLDEN)
    marks: dict[str | None, bytes] = {}

    def mark(group: str | None) -> bytes:
        if group not in marks:
            if len(marks) > 10_000:
                marks.clear()
            marks[group] = hashlib.blake2b(b"-" if group is None else b"+" + group.encode(), digest_size=16).digest()
        return marks[group]

    def batches(it):
        for batch in it:
            lists = batch.column("ids").cast(pa.large_list(pa.int64()))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if not lists.null_count else pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            flat = lists.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            row, value = row[known], flat.drop_null().to_numpy().astype(np.int64)
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))[: len(row)]
            row, value = row[new], value[new]
            size = np.bincount(row, minlength=len(lists))
            ok = np.flatnonzero(size >= least)
            keep = np.isin(row, ok)
            row, value, ends = row[keep], value[keep], np.concatenate(([0], np.cumsum(size[ok])))
            groups = batch.column("part").take(pa.array(ok)).to_pylist()
            group_marks = [mark(g) for g in groups]
            token = mix(value.view(np.uint64) + np.repeat(np.frombuffer(b"".join(m[:8] for m in group_marks), "<u8"), size[ok]))
            symbol = np.minimum.reduceat(mix(token[:, None] ^ salts[None, :]), ends[:-1], axis=0) if len(ok) else np.zeros((0, len(salts)), np.uint64)
            raw = value.astype("<i8")
            payload = [m + raw[a:b].tobytes() for m, a, b in zip(group_marks, ends[:-1], ends[1:])]
            ids = [hashlib.blake2b(x, digest_size=16).digest() for x in payload]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(ok)), pa.array(ids, pa.binary()), pa.array(size[ok].astype(np.int32)), _list(_band_hash(symbol.reshape(len(ok), bands, per_band))), pa.array(payload, pa.binary())],
                names=["key", "set_id", "size", "bands", "payload"],
            )

    return batches


# Comparison ---------------------------------------------------------------------------


def _jaccard_words(a: pa.Array, b: pa.Array, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    both = np.concatenate((_letters_payload(a), _letters_payload(b)))
    both.sort()
    hit = both[1:][both[1:] == both[:-1]]
    common = np.bincount((hit >> np.uint64(32)).astype(np.int64), minlength=len(size_a))
    return common / (size_a + size_b - common)


def _jaccard_lists(a: pa.Array, b: pa.Array, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    common = [0 if x[:16] != y[:16] else len(np.intersect1d(np.frombuffer(x[16:], "<i8"), np.frombuffer(y[16:], "<i8"), assume_unique=True)) for x, y in zip(a.to_pylist(), b.to_pylist())]
    common = np.array(common, np.int64)
    return common / (size_a + size_b - common)


def _compare(jaccard, least: float):
    step = 2000

    def batches(it):
        for batch in it:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                like = jaccard(part.column("pa"), part.column("pb"), *(part.column(c).to_numpy().astype(np.int64) for c in ("sa", "sb")))
                keep = pa.array(np.flatnonzero(like >= least - 1e-12))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep), pa.array(like).take(keep)], names=["a", "b", "similarity"])

    return batches


def _likeness(pairs: DataFrame, sketch: DataFrame, jaccard, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets share at least ``least`` of their union."""
    side = lambda x: sketch.select(F.col("key").alias(x), F.col("size").alias("s" + x), F.col("payload").alias("p" + x))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("sa", "sb") >= F.greatest("sa", "sb") * least - 1e-9)
    return full.mapInArrow(_compare(jaccard, least), "a long, b long, similarity double")


def _near(sketch: DataFrame, jaccard, threshold: float, agree: int) -> tuple[DataFrame, DataFrame]:
    """(copies, links): copies (key, rep) of keys that stand for no class, links (a, b, similarity) between reps."""
    sketch = written(sketch, "sketch")
    reps = sketch.groupBy("set_id").agg(F.min("key").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = written(sketch.select("set_id", "key").join(reps, "set_id").where("key <> rep").select("key", "rep"), "copies")
    heads = sketch.join(copies.select("key"), "key", "left_anti")  # a written table, so its size is known to the planner
    posts = heads.select("key", F.explode("bands").alias("bucket"))
    crowds = posts.groupBy("bucket").agg(F.min("key").alias("centre"), F.count("*").alias("members")).where("members > 1")
    posts = written(posts.join(crowds, "bucket"), "buckets")
    # The covering: a record's home is the centre it meets most, if that lies within RADIUS, else itself.
    near = posts.where("key <> centre").groupBy("key", "centre").agg(F.count("*").alias("n")).where(F.col("n") >= agree)
    wish = near.groupBy("key").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    homes = _likeness(wish.select(F.col("key").alias("a"), F.col("centre").alias("b")), sketch, jaccard, 1 - RADIUS)
    homes = written(homes.select(F.col("a").alias("key"), F.col("b").alias("anchor")), "homes")
    anchors = homes.select(F.col("anchor").alias("key")).distinct().withColumn("serves", F.lit(True))
    flagged = posts.drop("centre").join(homes.select("key", F.lit(True).alias("homed")), "key", "left").join(anchors, "key", "left")
    flagged = _thinned(flagged, heads)
    at_anchor = flagged.where("homed is null or serves").select("bucket", F.col("key").alias("anchor"), F.col("homed").alias("moved"), F.col("serves").alias("serves"), "bands")
    others = flagged.select("bucket", "key", F.col("homed").alias("away"))
    # Both their own anchor, and nobody else's: one of the two meetings is enough.
    once = F.col("moved").isNotNull() | F.col("serves").isNotNull() | F.col("away").isNotNull() | (F.col("anchor") < F.col("key"))
    reach = at_anchor.join(others, "bucket").where((F.col("anchor") != F.col("key")) & once)
    reach = reach.groupBy("anchor", "key", "moved", "serves", "away").agg(F.sum("bands").alias("n"))
    # A guest of an anchor lies farther off than a partner, so one band in common is enough to test its distance.
    reach = written(reach.where((F.col("n") >= agree) | F.col("serves").isNotNull() & F.col("away").isNotNull()), "reach")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    own = reach.where((F.col("n") >= agree) & F.col("moved").isNull()).select(*pair("anchor", "key"))
    guests = reach.where("serves").select(F.col("key").alias("a"), F.col("anchor").alias("b"))
    guests = _likeness(guests, sketch, jaccard, threshold - RADIUS).select(F.col("a").alias("other"), F.col("b").alias("anchor"))
    guests = guests.join(homes, "anchor").where("key <> other").select(*pair("key", "other"))
    pairs = own.unionByName(guests).unionByName(homes.select(*pair("key", "anchor"))).distinct()
    return copies, _likeness(pairs, sketch, jaccard, threshold)


def _thinned(flagged: DataFrame, heads: DataFrame) -> DataFrame:
    """Meetings with ``bands``, the number of bands that agree in one.

    A bucket with more than HOT records on the anchor side is not joined: as two
    bands have to agree, its records meet in it and each one of their other
    bands instead, which a band they share by chance, such as that of a common
    stretch, does not let them do. No pair with two bands in common is lost.
    """
    few, many = flagged.where(F.col("members") <= HOT).drop("members").withColumn("bands", F.lit(1)), flagged.where(F.col("members") > HOT).drop("members")
    anchor_side = F.col("homed").isNull() | F.coalesce(F.col("serves"), F.lit(False))
    hot = written(many.groupBy("bucket").agg(F.count_if(anchor_side).alias("m")).where(F.col("m") > HOT).select("bucket"), "hot")
    if not hot.head(1):
        return few.unionByName(many.withColumn("bands", F.lit(1)))
    both = many.join(hot, "bucket").join(heads.select("key", F.explode("bands").alias("second")), "key").where("second <> bucket")
    both = both.withColumn("bucket", F.xxhash64(F.least("bucket", "second"), F.greatest("bucket", "second"))).drop("second").distinct()
    cold = many.join(hot, "bucket", "left_anti").withColumn("bands", F.lit(1))
    return few.unionByName(cold).unionByName(written(both.withColumn("bands", F.lit(2)), "seconds"))


def near_sequences(df: DataFrame, key: str, seq: str, threshold: float = 0.6, least: int = 100, bands: int = 28) -> tuple[DataFrame, DataFrame]:
    """Rows whose sets of canonical 16-letter words share ``threshold`` of their union.

    Returns (copies, links). Only sets of ``least`` members count; windows with
    a letter other than A, C, G, T/U hold no word; rows with null key, and null
    or empty sequences, are in no pair; an empty table gives two empty results.
    Two bands of two symbols must agree: at a similarity of exactly 0.6 a pair
    stays unmet with a probability of 6e-5, at 0.7 of 5e-8.
    """
    rows = take(df, key=F.col(f"`{key}`").cast("long"), seq=seq).where("key is not null and seq is not null")
    return _near(rows.mapInArrow(_sketch_words(bands, 2, least), _SKETCH), _jaccard_words, threshold, 2)


def near_lists(df: DataFrame, key: str, group: str, ids: str, threshold: float = 0.7, least: int = 3, bands: int = 16) -> tuple[DataFrame, DataFrame]:
    """Rows of one group whose integer lists, as sets, share ``threshold`` of their union.

    Returns (copies, links). Nulls in a list are left out, a null list is in no
    pair; rows with a null group are one group. Two bands of one symbol must
    agree: at a similarity of exactly 0.7 a pair stays unmet with a probability
    of 2e-7.
    """
    rows = take(df, key=F.col(f"`{key}`").cast("long"), part=F.col(f"`{group}`").cast("string"), ids=F.col(f"`{ids}`").cast("array<long>")).where("key is not null and ids is not null")
    return _near(rows.mapInArrow(_sketch_lists(bands, 1, least), _SKETCH), _jaccard_lists, threshold, 2)


def expanded(copies: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b) of all rows in a pair: links between classes, and the pairs within each class."""
    def widen(df: DataFrame, side: str) -> DataFrame:
        more = df.join(copies.select(F.col("rep").alias(side), F.col("key").alias("copy")), side).withColumn(side, F.col("copy")).drop("copy")
        return df.unionByName(more)

    across = widen(widen(links.select("a", "b"), "a"), "b")
    within = copies.select(F.col("rep").alias("a"), F.col("key").alias("b"))
    within = within.unionByName(copies.alias("x").join(copies.alias("y"), "rep").where("x.key < y.key").select(F.col("x.key").alias("a"), F.col("y.key").alias("b")))
    both = across.unionByName(within)
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def classes(df: DataFrame, key: str, copies: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class_key, class_rows, n_links): each row's class of equal sets, and how many other classes that is linked to."""
    rows = take(df, key=F.col(f"`{key}`").cast("long")).where("key is not null")
    ends = links.select(F.explode(F.array("a", "b")).alias("class_key")).groupBy("class_key").agg(F.count("*").alias("n_links"))
    sizes = copies.groupBy(F.col("rep").alias("class_key")).agg((F.count("*") + 1).alias("class_rows"))
    out = rows.join(copies, "key", "left").select("key", F.coalesce("rep", "key").alias("class_key"))
    out = out.join(sizes, "class_key", "left").join(ends, "class_key", "left")
    return out.select("key", "class_key", F.coalesce("class_rows", F.lit(1)).alias("class_rows"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
