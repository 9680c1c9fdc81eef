"""Graph files as tables, in columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.kernels import jvm


def segments(lines: DataFrame, line: str = "line", *keep: str) -> DataFrame:
    """(keep, name, seq, tags) of S lines."""
    f = F.split(F.col(line), "\t")
    return lines.where(F.col(line).startswith("S\t")).select(*keep, F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(2)).alias("seq"), F.slice(f, 4, 1 << 20).alias("tags"))


def path_steps(lines: DataFrame, line: str = "line", *keep: str) -> DataFrame:
    """(keep, path, at, name, sign) of each step of P lines."""
    f = F.split(F.col(line), "\t")
    rows = lines.where(F.col(line).startswith("P\t")).select(*keep, F.get(f, F.lit(1)).alias("path"), F.posexplode(F.split(F.get(f, F.lit(2)), ",")).alias("at", "step"))
    return rows.select(*keep, "path", "at", F.expr("substring(step, 1, length(step) - 1)").alias("name"), F.expr("right(step, 1)").alias("sign"))


def walked(segment_table: DataFrame, steps: DataFrame, *keys: str) -> DataFrame:
    """Steps with their segment's sequence and the name of the next step; ``missing`` finds steps without a segment."""
    w = Window.partitionBy(*keys, "path").orderBy("at")
    return steps.withColumn("next_name", F.lead("name").over(w)).join(segment_table, [*keys, "name"])


def missing(segment_table: DataFrame, steps: DataFrame, *keys: str) -> DataFrame:
    return steps.join(segment_table, [*keys, "name"], "left_anti")


def spelt(graphs: DataFrame, *keep: str) -> DataFrame:
    """(keep, read, path, seq) of ``paths`` (read, P line) with the S lines of ``lines``, both lists of one graph a row; ``?`` for a step without a segment.

    ``keep`` names a row. Segments and paths meet in the row, where the JVM can be reached; else by joins.
    """
    if jvm.available(graphs.sparkSession):
        found = jvm.call(graphs, "array<struct<read:int,path:string,seq:string>>", F.col("lines"), F.col("paths"), kernel="Spell")
        return graphs.select(*keep, F.explode(found).alias("x")).select(*keep, "x.*")
    ways = graphs.select(*keep, F.posexplode("paths").alias("nth", "x")).select(*keep, "nth", "x.read", "x.line")
    known = segments(graphs.select(*keep, F.explode("lines").alias("line")), "line", *keep)
    steps = path_steps(ways, "line", *keep, "nth", "read").join(known, [*keep, "name"], "left").groupBy(*keep, "nth", "read", "path")
    return steps.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("seq", F.lit("?")).alias("seq")))), lambda x: x.seq), "").alias("seq")).drop("nth")


def tag(tags: str, name: str):
    """The value of a ``NAME:TYPE:value`` tag in an array of tags, as text."""
    return F.regexp_extract(F.get(F.filter(tags, lambda x: x.startswith(name + ":")), F.lit(0)), r"^[^:]*:[AifZHB]:(.*)$", 1)
