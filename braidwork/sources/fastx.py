"""FASTA and FASTQ files, and score matrices, as tables."""

from __future__ import annotations

import gzip
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.kernels.params import Params

RECORDS = "source string, read_id int, name string, comment string, seq string, qual string"


def fasta_fields(record: Column) -> list[Column]:
    """name, comment and seq of the text of one record, with or without its ``>``."""
    text = F.regexp_replace(record, "^>", "")
    head = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s", "")
    comment = F.regexp_extract(head, r"^\S*\s+(.*?)\s*$", 1)
    return [F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(comment != "", comment).alias("comment"), body.alias("seq")]


def parse_fasta(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Records of a column that holds whole FASTA texts, with their place in it."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), "\n>", -1)
    rows = df.select(*keep, F.posexplode(parts).alias("read_id", "record")).where("read_id > 0")
    return rows.select(*keep, (F.col("read_id") - 1).alias("read_id"), *fasta_fields(F.col("record")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(source, name, comment, seq) of FASTA files. Files are split at records, so large ones are read by many tasks."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("source", F.col("_metadata.file_path"))
    return rows.where(F.trim("value") != "").select("source", *fasta_fields(F.col("value")))


def parse_fastx(text: str) -> list[tuple[str, str | None, str, str | None]]:
    """Records of a text of FASTA and FASTQ records, in any mixture, sequences and qualities over one or more lines.

    Text before the first record is skipped. A quality that is cut off, or
    longer than its sequence, ends the reading with an error.
    """
    lines, at, out = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")], 0, []
    while at < len(lines) and not lines[at].startswith((">", "@")):
        at += 1
    while at < len(lines):
        name, comment = (lines[at][1:].split(None, 1) + ["", ""])[:2] if lines[at][1:2].strip() else ("", lines[at][1:].strip())
        at += 1
        seq = []
        while at < len(lines) and not lines[at].startswith((">", "@", "+")):
            seq.append("".join(lines[at].split()))
            at += 1
        s, qual = "".join(seq), None
        if at < len(lines) and lines[at].startswith("+"):
            at += 1
            q, n = [], 0
            while at < len(lines) and (n < len(s) or not s and not q):
                q.append(lines[at])
                n += len(lines[at])
                at += 1
            qual = "".join(q)
            if len(qual) != len(s):
                raise ValueError(f"quality of {name!r} is not as long as its sequence")
            while at < len(lines) and not lines[at].startswith((">", "@")):
                at += 1
        out.append((name, comment.strip() or None, s, qual))
    return out


_RECORDS = pa.schema([("source", pa.string()), ("read_id", pa.int32()), *((x, pa.string()) for x in ("name", "comment", "seq", "qual"))])


def read_fastx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, read_id, name, comment, seq, qual) of FASTA or FASTQ files of any layout, gzipped ones too, in the file's order.

    A file is one task and fits its memory; ``read_fasta`` and ``read_fastq``
    split large plain files.
    """

    def batches(it):
        for batch in it:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = parse_fastx(raw.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_pylist([{"source": name, "read_id": i, "name": n, "comment": c, "seq": s, "qual": q} for i, (n, c, s, q) in enumerate(rows)], schema=_RECORDS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(batches, RECORDS)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, name, comment, seq, qual) of plain FASTQ files with four lines a record, split at any size.

    A file is cut where a line feed is followed by ``@``. That may also be the
    start of a quality: a piece with three lines lacks its quality, and a piece
    with one line is one. Such neighbours are put together again, also where the
    second is the first of the next split.
    """
    meta = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("low"), (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("high")]
    rows = spark.read.option("lineSep", "\n@").text(path).select(*meta, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r", "").alias("value"))
    ends = rows.groupBy("source", "low").agg(F.min("at").alias("first"), F.max("at").alias("last"))  # a row a split
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), "\n+$", ""), "\n", -1)
    rows = rows.select("source", "low", "high", "at", lines.alias("l")).where((F.size("l") > 1) | (F.get("l", F.lit(0)) != ""))
    line = lambda i: F.get("l", F.lit(i))
    whole = rows.where("size(l) >= 4").select("source", line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"))
    cut = rows.where("size(l) < 4").join(ends, ["source", "low"])
    side = cut.where("size(l) = 3").select("source", (F.col("at") == F.col("last")).alias("over"), F.when(F.col("at") == F.col("last"), F.col("high")).otherwise(F.col("at") + 1).alias("next"), line(0).alias("head"), line(1).alias("seq"))
    rest = cut.where("size(l) < 3").select("source", (F.col("at") == F.col("first")).alias("over"), F.when(F.col("at") == F.col("first"), F.col("low")).otherwise(F.col("at")).alias("next"), F.concat(F.lit("@"), line(0)).alias("qual"))
    out = whole.unionByName(side.join(rest, ["source", "over", "next"], "full").drop("over", "next"))
    sound = F.coalesce(F.length("qual") == F.length("seq"), F.lit(False))
    qual = F.when(sound, F.col("qual")).otherwise(F.raise_error(F.concat(F.lit("quality is not as long as its sequence: "), F.coalesce("head", "qual"))))
    comment = F.regexp_extract("head", r"^\S*\s+(.*?)\s*$", 1)
    return out.select("source", F.regexp_extract("head", r"^(\S*)", 1).alias("name"), F.when(comment != "", comment).alias("comment"), "seq", qual.alias("qual"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files named in a list, one a line; each file is a group, numbered from 1 as ``batch_index``.

    The list is read by the driver, since Spark needs all paths to plan a scan.
    A file that gives no path as Spark reports it stops the query.
    """
    names = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]  # the names alone
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def full(name: str) -> str:
        """The path as Spark reports it, whatever its scheme or form here."""
        p = jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(conf).makeQualified(p).toString()

    order = spark.createDataFrame([(full(n), n, i) for i, n in enumerate(names, 1)], "source string, group_id string, batch_index int")
    rows = read_fastx(spark, names).join(order, "source", "left")
    known = F.when(F.col("batch_index").isNotNull(), F.col("batch_index")).otherwise(F.raise_error(F.concat(F.lit("not a file of the list: "), F.col("source"))).cast("int"))
    return rows.withColumn("batch_index", known)


def parse_matrix(lines: Iterable[str], params: Params) -> np.ndarray:
    """A score matrix: ``#`` comments, a line of column letters, then a letter and its scores a line.

    A row labelled ``*`` is read as such, and its first score keeps its sign.
    """
    out, columns = np.zeros((params.m, params.m), np.int32), None
    code = lambda c: int(params.encode(c)[0])
    for line in lines:
        fields = line.split()
        if not fields or fields[0].startswith("#"):
            continue
        if columns is None:
            columns = [code(c) for c in fields]
            continue
        for column, score in zip(columns, fields[1:]):
            out[code(fields[0]), column] = int(score)
    return out


def read_matrix(path: str, params: Params, spark: SparkSession | None = None) -> np.ndarray:
    """The matrix of a file; with ``spark`` from any file system it reads. A matrix has a line for each letter."""
    if spark is not None:
        return parse_matrix(spark.read.text(path, wholetext=True).first().value.split("\n"), params)
    with open(path) as f:
        return parse_matrix(f, params)
