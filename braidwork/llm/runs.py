"""Runs of equal consecutive events, found as backreference matches on symbol strings.

Canonical events become Unicode code points and an entity's events one string;
``(x)\\1*`` finds the runs, and match positions index the step and time arrays.

An entity is cut into blocks of 2**16 step numbers, so no string holds more
than 65,536 symbols whatever share of the rows one entity has. Runs that touch
the edge of a block are joined again afterwards; 32-bit step numbers allow at
most 2**17 such pieces an entity.

Defined results: rows with null entity or order value are left out, as they
have no place in a sequence; of rows with equal (entity, order) the one with
the smallest tie value counts, null being largest; a null event, or an order
value that is missing, ends a run. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16
_HALF = 1 << (BLOCK_BITS - 1)
_FIRST_SYMBOL, _SYMBOLS = 0x10000, 0x40000  # neighbouring stretches use two alphabets in turn, so no match crosses a gap
_PIECES = "entity {0}, block long, event string, first long, last long, t0 long, t1 long, dwell long, timed long, low boolean, high boolean"


def residue_event(column: str | Column) -> Column:
    """A, C, G, T (also for U) or N, without regard to case; null and empty stay null."""
    c = F.upper(F.col(f"`{column}`") if isinstance(column, str) else column)
    c = F.when(c == "U", "T").otherwise(c)
    return F.when(c == "", F.lit(None)).when(c.isin("A", "C", "G", "T"), c).otherwise(F.when(c.isNotNull(), "N"))



def _matcher(min_run: int):
    pattern = re.compile(r"(.)\1{%d,}" % (min_run - 1), re.DOTALL)
    any_run = re.compile(r"(.)\1*", re.DOTALL)

    def batches(it):
        for batch in it:
            events = batch.column("events")
            lens = np.diff(np.asarray(events.offsets))
            n = int(lens.sum())
            if n == 0:
                continue
            values = events.values.slice(events.offsets[0].as_py(), n)
            names, steps = values.field("event").to_pandas().to_numpy(), values.field("step").to_numpy()
            at, dwell = (values.field(c).to_pandas() for c in ("at", "dwell"))
            symbol, known = pd.factorize(names, use_na_sentinel=True)
            row = np.repeat(np.arange(len(lens)), lens)
            cut = np.ones(n, bool)
            cut[1:] = (row[1:] != row[:-1]) | (steps[1:] != steps[:-1] + 1)
            code = symbol % _SYMBOLS
            cut[1:] |= (code[1:] == code[:-1]) & (symbol[1:] != symbol[:-1])
            parity = np.cumsum(cut) & 1
            null = symbol < 0
            points = np.where(null, 0x20 + (np.arange(n) & 1), _FIRST_SYMBOL + code + _SYMBOLS * parity).astype("<u4")
            text = points.tobytes().decode("utf-32-le")
            block = batch.column("block").to_numpy()
            lo = (block << BLOCK_BITS) - _HALF
            ends = np.concatenate(([0], np.cumsum(lens)))
            edged = bool(np.any((steps[ends[:-1][lens > 0]] == lo[lens > 0]) | (steps[ends[1:][lens > 0] - 1] == lo[lens > 0] + (1 << BLOCK_BITS) - 1)))
            spans = np.array([m.span() for m in (any_run if edged else pattern).finditer(text)], np.int64).reshape(-1, 2)
            a, b = spans[:, 0], spans[:, 1] - 1
            low, high = steps[a] == lo[row[a]], steps[b] == lo[row[a]] + (1 << BLOCK_BITS) - 1
            keep = ~null[a] & (low | high | (b - a + 1 >= min_run))
            a, b, low, high = a[keep], b[keep], low[keep], high[keep]
            if not len(a):
                continue
            # times: first and last known in the run; dwell: sum of the known, and how many were known
            cut_at = np.empty(2 * len(a), np.int64)
            cut_at[::2], cut_at[1::2] = a, b + 1
            over = lambda f, x, pad: f.reduceat(np.append(x, pad), cut_at)[::2]
            big = np.iinfo(np.int64).max
            missing = at.isna().to_numpy()
            when = at.fillna(0).to_numpy().astype(np.int64)
            t0, t1 = over(np.minimum, np.where(missing, big, when), big), over(np.maximum, np.where(missing, -big, when), -big)
            timed, spent = over(np.add, (~dwell.isna()).to_numpy().astype(np.int64), 0), over(np.add, dwell.fillna(0).to_numpy().astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("entity").take(pa.array(row[a])),
                    pa.array(block[row[a]]),
                    pa.array(np.asarray(known, object)[symbol[a]], pa.string()),
                    pa.array(steps[a].astype(np.int64)),
                    pa.array(steps[b].astype(np.int64)),
                    pa.array(t0, mask=t0 == big),
                    pa.array(t1, mask=t1 == -big),
                    pa.array(spent),
                    pa.array(timed),
                    pa.array(low),
                    pa.array(high),
                ],
                names=["entity", "block", "event", "first", "last", "t0", "t1", "dwell", "timed", "low", "high"],
            )

    return batches


def collapse_runs(df: DataFrame, entity: str, order: str, event: str | Column, tie: str, at: str | None = None, dwell: str | None = None, min_run: int = 1) -> DataFrame:
    """One row a run of at least ``min_run`` rows.

    Columns: entity, event, first_step, last_step, n_steps, started_at and
    ended_at (first and last known time), duration_us (between them), dwell_us
    (sum of the known dwell times) and n_dwell (how many were known).
    """
    event = F.col(f"`{event}`") if isinstance(event, str) else event
    rows = df.select(
        F.col(f"`{entity}`").alias("entity"),
        F.col(f"`{order}`").cast("long").alias("step"),
        F.coalesce(F.col(f"`{tie}`").cast("long"), F.lit((1 << 63) - 1)).alias("tie"),
        event.alias("event"),
        (F.unix_micros(F.col(f"`{at}`").cast("timestamp")) if at else F.lit(None).cast("long")).alias("at"),
        (F.col(f"`{dwell}`").cast("long") if dwell else F.lit(None).cast("long")).alias("dwell"),
    ).where("entity is not null and step is not null")
    # The first of the rows delivered again; partial aggregation runs before the shuffle.
    once = rows.groupBy("entity", "step").agg(F.min(F.struct("tie", "event", "at", "dwell")).alias("x")).select("entity", "step", "x.event", "x.at", "x.dwell")
    strings = once.groupBy("entity", F.shiftright(F.col("step") + _HALF, BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("step", "event", "at", "dwell"))).alias("events"))
    found = strings.mapInArrow(_matcher(min_run), _PIECES.format(dict(rows.dtypes)["entity"]))
    # Pieces at an edge meet in one group an entity; the others keep their block's.
    found = found.withColumn("home", F.when(F.col("low") | F.col("high"), F.lit(None).cast("long")).otherwise(F.col("block")))
    w = Window.partitionBy("entity", "home").orderBy("first")
    goes_on = F.col("low") & F.lag("high").over(w) & (F.lag("last").over(w) + 1 == F.col("first")) & (F.lag("event").over(w) == F.col("event"))
    joined = found.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = joined.groupBy("entity", "home", "run").agg(F.first("event").alias("event"), F.min("first").alias("first_step"), F.max("last").alias("last_step"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("dwell").alias("dwell_us"), F.sum("timed").alias("n_dwell"))
    runs = runs.withColumn("n_steps", F.col("last_step") - F.col("first_step") + 1).where(F.col("n_steps") >= min_run)
    return runs.select(
        F.col("entity").alias(entity), "event", "first_step", "last_step", "n_steps",
        F.timestamp_micros("t0").cast("timestamp_ntz").alias("started_at"), F.timestamp_micros("t1").cast("timestamp_ntz").alias("ended_at"),
        (F.col("t1") - F.col("t0")).alias("duration_us"), "dwell_us", "n_dwell",
    )
