"""Groups of rows as a stream of Arrow batches: a task takes its groups one after another and keeps only those in work."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TARGET = 64 << 20  # bytes of input a task, about


def tasks_for(df: DataFrame) -> int:
    """How many tasks: two a core at least, more for large tables, up to the session's shuffle partitions.

    The number is stated, since a kernel's time has little to do with the bytes
    by which small shuffles are merged.
    """
    spark = df.sparkSession
    least = 2 * spark.sparkContext.defaultParallelism
    most = max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(most, max(least, size // _TARGET))


def grouped(df: DataFrame, key: str, *order: str, partitions: int | None = None) -> DataFrame:
    """Rows of a group next to one another, in order, after one shuffle on the key."""
    return df.repartition(partitions or tasks_for(df), key).sortWithinPartitions(key, *order)


def each_group(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict[str, list]]]:
    """(key, columns) of each group of such a stream, wherever the batches were cut; null is a key like any other."""
    name, kept = None, None
    for batch in batches:
        columns = batch.to_pydict()
        keys = columns[key]
        start = 0
        while start < len(keys):
            stop = start + 1
            while stop < len(keys) and keys[stop] == keys[start]:
                stop += 1
            if kept is not None and keys[start] == name:
                for c, values in columns.items():
                    kept[c] += values[start:stop]
            else:
                if kept is not None:
                    yield name, kept
                name, kept = keys[start], {c: values[start:stop] for c, values in columns.items()}
            start = stop
    if kept is not None:
        yield name, kept


def tables(rows: Iterable[dict], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows as record batches."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield from pa.Table.from_pylist(held, schema=schema).to_batches()
            held = []
    if held:
        yield from pa.Table.from_pylist(held, schema=schema).to_batches()
