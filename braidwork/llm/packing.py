"""Filling fixed-capacity containers, by patterns of few documents fitted to the histogram.

The plan is made on the histogram of item sizes, which has at most ``capacity``
entries whatever the number of items. Sizes fall into BINS classes; patterns
are the multisets of at most PARTS classes that fill a container; non-negative
least squares gives how often each pattern is to be repeated to meet the
histogram; the counts are rounded down, each repeat gets exact sizes that close
its container, and what is left goes, longest first, into the tightest gap that
holds it. Patterns can use up the short items that gaps need, so a few plans
that use the fit more or less fully are made and the best one is taken. Items far shorter than a container are first put together, by the same
plan, into bundles of a quarter of the capacity, so that few parts fill it.

The plan says, for each size, which ranks go where; items are ranked within
their size over salted groups, so no size is ever gathered in one task, and
each item finds its container by two searches in the plan.

Only an item above the capacity is cut: into pieces of exactly the capacity
and a rest. Defined results: items without size are spread over the containers
(container null if there is none); a null size counts as 0; rows with a null
id are items too; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.plans.columns import take
from braidwork.plans.lineage import written

BINS, PARTS, LEAST = 32, 4, 64
SINGLES, SHARES = (0.25, 0.8), (1.0, 0.75, 0.5, 0.25, 0.1)  # settings tried for each plan
CLOSED = 1024  # a pattern may leave the capacity / CLOSED of a container empty
RANKED = 1_000_000  # rows of one size ranked in one task


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| least: columns enter one by one while they help and leave when they turn negative."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        inside[j] = True
        while True:
            at = np.flatnonzero(inside)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-30))
            x[at] += step * (z - x[at])
            out = at[(x[at] <= 1e-12) | (low & (x[at] <= 1e-9))]
            if not len(out):
                out = at[low][:1]
            x[out] = 0
            inside[out] = False
            if not inside.any():
                break
    return x


class Plan:
    """Containers of one capacity: groups of equal filling, each a Counter of sizes and a number of containers."""

    def __init__(self, counts: dict[int, int], capacity: int, single: float = SINGLES[0], share: float = SHARES[0]):
        """``single``: the part of the short items that stay single, to fill gaps; ``share``: the part of the fitted repeats that is used."""
        self.capacity, self.bundles = capacity, None
        left = Counter({s: n for s, n in counts.items() if n > 0})
        self.low = {s: n - math.ceil(n * single) for s, n in left.items() if s <= capacity // 8} if capacity // 4 >= LEAST else {}
        if sum(self.low.values()) > 4:
            self.bundles = Plan(self.low, capacity // 4, single)
            left -= Counter(self.low)
            for filling, n in self.bundles.groups:
                left[sum(s * m for s, m in filling.items())] += n
        self.groups: list[tuple[Counter, int]] = []
        before = sum(s * n for s, n in left.items())
        gaps = self._patterns(left, share)
        self.by_pattern = before - sum(s * n for s, n in left.items())  # tokens
        self._residual(left, gaps)
        for held in gaps.values():
            self.groups.extend(held)
        self.groups = [(f, n) for f, n in self.groups if n]
        self.containers = sum(n for _, n in self.groups)
        self._index()

    def _patterns(self, left: Counter, share: float) -> dict[int, list]:
        """Takes the patterns' items out of ``left``; returns the fillings by the gap they leave.

        A class spans capacity / BINS sizes, so parts that fill a container have
        classes that sum up to BINS or little more. A repeat of a pattern takes
        the longest items of its classes, and two for the last that close the
        container but for ``capacity // CLOSED`` tokens; a repeat that cannot be
        closed is given up, and its items are packed as residuals.
        """
        gaps: dict[int, list] = defaultdict(list)
        width, slack = self.capacity / BINS, self.capacity // CLOSED
        bin_of = lambda s: min(BINS, max(1, int(-(-s // width))))
        sizes: dict[int, list[int]] = defaultdict(list)
        for s in sorted(left):
            sizes[bin_of(s)].append(s)
        used = sorted(sizes)
        fill = [p for k in range(1, PARTS + 1) for p in combinations_with_replacement(used, k) if BINS <= sum(p) < BINS + k]
        if not fill:
            return gaps
        a = np.zeros((len(used), len(fill)))
        for j, p in enumerate(fill):
            for b in p:
                a[used.index(b), j] += 1
        weight = np.array(used, float)
        want = np.array([sum(left[s] for s in sizes[b]) for b in used], float)
        free = lambda s, filling: left[s] - filling[s] > 0

        def closed(filling: Counter, room: int, classes: tuple[int, ...]) -> Counter | None:
            """With two more parts, or one, that close what is left."""
            if len(classes) == 1:
                return next((filling + Counter({s: 1}) for s in range(room, max(0, room - slack - 1), -1) if bin_of(s) in (classes[0], classes[0] - 1, classes[0] + 1) and free(s, filling)), None)
            for s in reversed(sizes[classes[0]]):
                if s < room and free(s, filling):
                    one = filling + Counter({s: 1})
                    if (both := closed(one, room - s, classes[1:])) is not None:
                        return both
            return None

        for j, times in sorted(enumerate(nnls(a * weight[:, None], want * weight)), key=lambda x: -x[1]):
            times, classes = int(times * share + 1e-6), fill[j][::-1]
            while times > 0:
                filling, room = Counter(), self.capacity
                for b in classes[:-2]:
                    s = next((s for s in reversed(sizes[b]) if s < room and free(s, filling)), None)
                    if s is None:
                        room = 0
                        break
                    filling[s] += 1
                    room -= s
                filling = closed(filling, room, classes[-2:]) if room > 0 else None
                if filling is None:
                    break
                n = min(times, *(left[s] // m for s, m in filling.items()))
                for s, m in filling.items():
                    left[s] -= n * m
                    if not left[s]:
                        sizes[bin_of(s)].remove(s)
                gaps[self.capacity - sum(s * m for s, m in filling.items())].append((filling, n))
                times -= n
        return gaps

    def _residual(self, left: Counter, gaps: dict[int, list]) -> None:
        keys = sorted(gaps)

        def put(gap: int, filling: Counter, n: int) -> None:
            if n:
                if not gaps.get(gap):
                    bisect.insort(keys, gap)
                    gaps[gap] = []
                gaps[gap].append((filling, n))

        for s in sorted(left, reverse=True):
            c = left[s]
            while c > 0:
                at = bisect.bisect_left(keys, s)
                if at == len(keys):
                    each = self.capacity // s
                    if c >= each:
                        put(self.capacity - each * s, Counter({s: each}), c // each)
                    if c % each:
                        put(self.capacity - (c % each) * s, Counter({s: c % each}), 1)
                    c = 0
                    continue
                gap = keys[at]
                filling, n = gaps[gap].pop()
                if not gaps[gap]:
                    del keys[at], gaps[gap]
                each = min(gap // s, c)
                use = min(n, c // each)
                put(gap - each * s, filling + Counter({s: each}), use)
                put(gap, filling, n - use)
                c -= use * each
        left.clear()

    def _index(self) -> None:
        """For each size: first ranks, containers they start at, and items of the size a container."""
        start, base = Counter(), 0
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for filling, n in self.groups:
            for s, m in filling.items():
                rows[s].append((start[s], base, m))
                start[s] += n * m
            base += n
        flat = [(s, *r) for s in sorted(rows) for r in rows[s]]
        self.sizes = np.array(sorted(rows), np.int64)
        self.table = np.array(flat, np.int64).reshape(-1, 4)
        if self.bundles is not None:  # a bundle's rank among the items of its size: items of that size proper come first
            self.ranks = []
            own: Counter = Counter()
            base = 0
            for filling, n in self.bundles.groups:
                size = sum(s * m for s, m in filling.items())
                self.ranks.append((base, size, own[size]))
                own[size] += n
                base += n
            self.ranks = np.array(self.ranks, np.int64).reshape(-1, 3)
            self.bundled = own

    def locate(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item; ``rank`` counts from 0 within its size."""
        if not len(size):
            return np.zeros(0, np.int64)
        size, rank = size.copy(), rank.copy()
        if self.bundles is not None:
            known = np.array(sorted(set(self.low) | set(self.bundled)), np.int64)
            at = np.minimum(np.searchsorted(known, size), len(known) - 1)
            hit = known[at] == size
            put = np.where(hit, np.array([self.low.get(int(s), 0) for s in known])[at], 0)
            ahead = np.where(hit, np.array([self.bundled[int(s)] for s in known])[at], 0)
            low = rank < put
            bundle = self.bundles.locate(size[low], rank[low])
            rank += ahead - put  # behind the bundles of the same size
            nth = np.searchsorted(self.ranks[:, 0], bundle, side="right") - 1
            size[low] = self.ranks[nth, 1]
            rank[low] = self.ranks[nth, 2] + bundle - self.ranks[nth, 0]
        # one key for size and rank; both fit in 62 bits
        top = int(self.table[:, 1].max(initial=0)) + int(rank.max(initial=0)) + 2
        at = np.searchsorted(self.table[:, 0] * top + self.table[:, 1], size * top + rank, side="right") - 1
        return self.table[at, 2] + (rank - self.table[at, 1]) // self.table[at, 3]


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Of the plans with the settings tried the one with the fewest containers, then with the most placed by patterns.

    A plan costs the driver some hundredths of a second, whatever the number of items.
    """
    return min((Plan(counts, capacity, single, share) for single in SINGLES for share in SHARES), key=lambda p: (p.containers, -p.by_pattern))


def _place(plan: Plan):
    def batches(it):
        for batch in it:
            size, rank = (batch.column(c).to_numpy() for c in ("tokens", "rank"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "tokens")), pa.array(plan.locate(size, rank))], names=["id", "piece", "tokens", "container"])

    return batches


def ranked(items: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Items with their rank within their size, from 0. A size of many rows is ranked in salted parts."""
    spark = items.sparkSession
    salts = spark.createDataFrame([(s, -(-n // RANKED)) for s, n in counts.items() if n > RANKED], "tokens long, salts long")  # at most one row for each RANKED items
    parts = items.join(F.broadcast(salts), "tokens", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "piece"), "salts"), F.lit(0).cast("long"))).drop("salts")
    nth = parts.withColumn("nth", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("id", "piece")))
    if all(n <= RANKED for n in counts.values()):
        return nth.select("id", "piece", "tokens", (F.col("nth") - 1).cast("long").alias("rank"))
    sums = parts.groupBy("tokens", "salt").count()
    before = sums.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return nth.join(before, ["tokens", "salt"]).select("id", "piece", "tokens", (F.col("nth") - 1 + F.col("before")).cast("long").alias("rank"))


def pack(sized: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """(key, piece, first_token, tokens, container) of every item; ``sized`` is read several times."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = take(sized, id=key, size=F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)))
    pieces = rows.where("size > 0").select("id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity).cast("long"))).alias("piece", "p"), "size")
    items = pieces.select("id", F.col("piece").cast("long").alias("piece"), F.least(F.col("size") - F.col("p") * capacity, F.lit(capacity).cast("long")).alias("tokens"))
    counts = {r[0]: r[1] for r in items.groupBy("tokens").count().collect()}  # at most ``capacity`` rows
    plan = best_plan(counts, capacity)
    kind = dict(rows.dtypes)["id"]
    placed = ranked(items, counts).mapInArrow(_place(plan), f"id {kind}, piece long, tokens long, container long") if counts else items.withColumn("container", F.lit(None).cast("long"))
    nowhere = F.pmod(F.xxhash64("id"), F.lit(plan.containers).cast("long")) if plan.containers else F.lit(None).cast("long")
    empty = rows.where("size = 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("tokens"), nowhere.alias("container"))
    both = placed.unionByName(empty)
    return both.select(F.col("id").alias(key), "piece", (F.col("piece") * capacity).alias("first_token"), "tokens", "container")


def pack_all(sized: DataFrame, key: str, tokens: str, capacities: dict[int, int], tokenizer: str) -> DataFrame:
    """The assignment for each spec; ``sized`` is written once and read for each."""
    sized = written(take(sized, **{key: key, tokens: tokens}), "sizes")
    out = None
    for spec, capacity in sorted(capacities.items()):
        one = pack(sized, key, tokens, capacity).select(F.lit(spec).alias("spec_id"), F.lit(capacity).alias("capacity_tokens"), F.lit(tokenizer).alias("tokenizer"), "*")
        out = one if out is None else out.unionByName(one)
    return out
