"""Mixing sources to target weights, by balanced sampling with the cube method.

Unless it is given, the total is the largest at which no source with documents needs more repeats
than it may have, so the shares of these sources stand to each other exactly as
their targets do. A source then needs r uses a document: each document is used
floor(r) times, and once more with probability r - floor(r). Which ones is
drawn by the cube method: probabilities move through the null space of the
constraints (tokens and documents of the source) until they reach 0 or 1, so
both totals are kept throughout. Flights run over blocks of BLOCK documents;
of each block at most two documents stay undecided, which fly again together,
level by level, until two a source are left to the landing, which rounds them
and makes up for the tokens by exchanges of documents of about the same size.

Defined results: documents without tokens, id, or a target source are not
drawn; a source without documents gets nothing and its share goes to the
others in proportion; repeated rows are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import random

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.plans.columns import take
from braidwork.plans.lineage import written

BLOCK = 20_000


def plain_source(column: str) -> Column:
    """Spellings that differ in case and outer white space are one source."""
    return F.lower(F.trim(F.col(f"`{column}`")))


def flight(size: list[int], chance: list[float], seed: int) -> list[float]:
    """Moves the chances of a block along the null space of (size, 1) until at most two are open.

    Three open documents, or two of one size, always have such a direction; a
    random step along it, of expectation zero, decides at least one of them.
    The next ones follow in the order given, longest first.
    """
    rng, p = random.Random(seed), list(chance)
    open_: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        open_.append(i)
        while len(open_) == 3 or len(open_) == 2 and size[open_[0]] == size[open_[1]]:
            a, b, c = (*(size[j] for j in open_), None)[:3]
            if a == b:
                move = [(open_[0], 1.0), (open_[1], -1.0)]
            elif b == c:
                move = [(open_[1], 1.0), (open_[2], -1.0)]
            elif a == c:
                move = [(open_[0], 1.0), (open_[2], -1.0)]
            else:
                most = max(abs(b - c), abs(c - a), abs(a - b))
                move = list(zip(open_, ((b - c) / most, (c - a) / most, (a - b) / most)))
            up = min((1 - p[j]) / u if u > 0 else p[j] / -u for j, u in move if u)
            down = min(p[j] / u if u > 0 else (1 - p[j]) / -u for j, u in move if u)
            step = up if rng.random() * (up + down) < down else -down
            for j, u in move:
                x = p[j] + step * u
                p[j] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            open_ = [j for j in open_ if 0 < p[j] < 1]
    return p


def landing(size: list[int], chance: list[float], wanted: list[float]) -> list[float]:
    """Decides the few that are open, so that the documents come closest to what was wanted, and then exchanges for the tokens.

    What the open ones shift in tokens is made up for by exchanging a drawn
    document for one not drawn whose size differs by just that; two exchanges
    at most, and none that does not bring the tokens closer. ``wanted``: the
    chances before the flight; only documents with a chance take part.
    """
    p = list(chance)
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    if not left:
        return p
    want, docs = sum(size[i] * x for i, x in enumerate(wanted)), sum(wanted)
    fixed_docs, fixed = sum(x for x in p if x in (0, 1)), sum(size[i] * x for i, x in enumerate(p) if x in (0, 1))
    choices = [[m >> k & 1 for k in range(len(left))] for m in range(1 << len(left))]
    best = min(choices, key=lambda c: (round(abs(fixed_docs + sum(c) - docs), 6) >= 1, abs(fixed + sum(size[i] * x for i, x in zip(left, c)) - want)))
    for i, x in zip(left, best):
        p[i] = float(x)
    for _ in range(2):
        off = want - sum(size[i] * x for i, x in enumerate(p))
        free = sorted((size[i], i) for i, x in enumerate(p) if x == 0 and wanted[i] > 0)
        swap, rest = None, abs(off)
        for i, x in enumerate(p):
            if x == 1 and wanted[i] < 1 and free:
                at = bisect.bisect_left(free, (size[i] + off, -1))
                for s, j in free[max(0, at - 1) : at + 1]:
                    if abs(off - (s - size[i])) < rest - 1e-9:
                        swap, rest = (i, j), abs(off - (s - size[i]))
        if swap is None:
            break
        p[swap[0]], p[swap[1]] = 0.0, 1.0
    return p


def _fly(last: bool):
    def group(table):
        # longest first, so that the undecided ones are short
        table = table.sort_by([("tokens", "descending"), ("order", "ascending"), ("id", "ascending")])
        size, chance = table.column("tokens").to_pylist(), table.column("chance").to_pylist()
        seed = xxhash.xxh64_intdigest(f"{table.column('source')[0].as_py()}/{table.column('block')[0].as_py()}/{table.num_rows}")
        p = flight(size, chance, seed)
        p = landing(size, p, chance) if last else p
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(p, pa.float64()))

    return group


def needed(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Uses a document of each source, none above its limit.

    Without ``total``, the largest amount at which the shares stand to each
    other exactly as the targets. With it, that many tokens as far as the limits
    allow: what a source at its limit cannot give, the others give in proportion.
    """
    there = {s: (share, most) for s, (share, most) in targets.items() if share > 0 and most > 0 and totals.get(s, 0) > 0}
    if not there:
        return {}
    if total is None:
        whole = sum(share for share, _ in there.values())
        total = min(most * totals[s] * whole / share for s, (share, most) in there.items())
    uses: dict[str, float] = {}
    open_ = dict(there)
    while open_:
        rest = total - sum(uses[s] * totals[s] for s in uses)
        whole = sum(share for share, _ in open_.values())
        full = [s for s, (share, most) in open_.items() if share / whole * rest > most * totals[s] * (1 + 1e-12)]
        for s in full or list(open_):
            share, most = open_.pop(s)
            uses[s] = float(most) if full else min(float(most), max(0.0, share / whole * rest / totals[s]))
    return uses


def mix(sized: DataFrame, key: str, source: str | Column, tokens: str, targets: dict[str, tuple[float, int]], total: int | None = None) -> DataFrame:
    """(key, source, tokens, repeats) of the documents drawn. ``targets``: source to (share, most repeats); ``total``: tokens to draw, see ``needed``."""
    source = plain_source(source) if isinstance(source, str) else source
    rows = take(sized, id=key, source=source, tokens=F.col(f"`{tokens}`").cast("long")).where("id is not null and tokens > 0").where(F.col("source").isin(list(targets)))
    rows = written(rows, "sources")
    kind = dict(rows.dtypes)["id"]
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}  # a row for each target
    uses = needed({s: t for s, (t, _) in totals.items()}, targets, total)
    if not uses:
        return rows.select(F.col("id").alias(key), "source", "tokens", F.lit(0).alias("repeats")).limit(0)
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for s in uses for x in (s, values(s))]), F.col("source"))
    whole = {s: math.floor(u + 1e-12) for s, u in uses.items()}
    blocks = {s: -(-totals[s][1] // BLOCK) for s in uses}
    drawn = rows.where(F.col("source").isin(list(uses))).select(
        "id", "source", "tokens", pick(lambda s: whole[s]).alias("base"), pick(lambda s: max(0.0, uses[s] - whole[s])).alias("chance"), F.xxhash64("id").alias("order"),
    )
    shape = f"id {kind}, source string, tokens long, base int, chance double, order long, block long"
    done = None
    while True:
        drawn = drawn.withColumn("block", F.pmod(F.shiftright("order", 7), pick(lambda s, b=dict(blocks): b[s])).cast("long"))
        last = all(b == 1 for b in blocks.values())
        flown = drawn.groupBy("source", "block").applyInArrow(_fly(last), shape)
        if last:
            done = flown if done is None else done.unionByName(flown)
            break
        flown = written(flown, "flight")
        settled = flown.where("chance <= 0 or chance >= 1")
        done = settled if done is None else done.unionByName(settled)
        drawn = flown.where("chance > 0 and chance < 1").drop("block")
        blocks = {s: -(-2 * b // BLOCK) for s, b in blocks.items()}
    out = done.withColumn("repeats", (F.col("base") + F.round("chance")).cast("int")).where("repeats > 0")
    return out.select(F.col("id").alias(key), "source", "tokens", "repeats")


def shares(mixed: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, most_repeats, tokens, share) of every target source."""
    spark = mixed.sparkSession
    want = spark.createDataFrame([(s, float(a), int(b)) for s, (a, b) in targets.items()], "source string, target_share double, max_repeats int")
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    out = want.join(got, "source", "left").na.fill(0, ["n_docs", "most_repeats", "tokens"])
    total = whole.first()[0] or 0
    return out.withColumn("share", F.round(F.col("tokens") / F.lit(float(total)), 6) if total else F.lit(0.0))
