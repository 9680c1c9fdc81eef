"""The llm queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import mixing, near, oracle, packing, residue, runs, spans, terms, tokens
from braidwork.plans.lineage import written


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_runs(spark: SparkSession, sf: str, min_run: int = 1) -> DataFrame:
    t = _table(spark, sf, "call_steps")
    return runs.collapse_runs(t, "read_key", "step_no", runs.residue_event("seq"), "step_id", "called_at", "dwell_us", min_run)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_runs(spark, sf, 6).select("read_key", "first_step", "last_step")


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_counts(_table(spark, sf, "seq_reads"), "seq")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_terms(spark, sf).where("mark is not null").select("term", "mark")


def _near(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, str, tuple[DataFrame, DataFrame]]]:
    reads, cons = _table(spark, sf, "seq_reads"), _table(spark, sf, "consensus")
    return {
        "read": (reads, "read_key", near.near_sequences(reads, "read_key", "seq")),
        "cons": (cons, "cons_key", near.near_lists(cons, "cons_key", "group_id", "clu_read_ids")),
    }


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    one, two = (near.expanded(*x).select(F.lit(kind).alias("kind"), "key_a", "key_b") for kind, (_, _, x) in _near(spark, sf).items())
    return one.unionByName(two)


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    one, two = (near.classes(t, key, *x).withColumn("kind", F.lit(kind)) for kind, (t, key, x) in _near(spark, sf).items())
    return one.unionByName(two)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf, "seq_reads"), "read_key", "seq")


def p5_cover(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_cover(_table(spark, sf, "seq_reads"), "read_key", "seq")


def _sizes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return tokens.token_sizes(_table(spark, sf, "documents").select(*columns, "text"))


def p6_assignment(spark: SparkSession, sf: str) -> DataFrame:
    specs = {r.spec_id: r.capacity_tokens for r in _table(spark, sf, "pack_specs").collect()}  # the specs to run, a few rows
    return packing.pack_all(_sizes(spark, sf, "doc_id"), "doc_id", "tokens", specs, tokens.TOKENIZER)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    used = p6_assignment(spark, sf).groupBy("spec_id", "capacity_tokens", "tokenizer").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p6_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the assignment, counted for each spec."""
    placed = written(p6_assignment(spark, sf), "placed")
    docs = placed.groupBy("spec_id", "capacity_tokens", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min("first_token").alias("low"), F.max(F.col("first_token") + F.col("tokens")).alias("high"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    by_doc = docs.groupBy("spec_id", "capacity_tokens").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n") != pieces).alias("cut_wrongly"), F.count_if((F.col("low") != 0) | (F.col("high") != F.col("tokens"))).alias("incomplete"))
    full = placed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"), F.first("capacity_tokens").alias("c")).groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("c")).alias("overfull"))
    return by_doc.join(full, "spec_id")


def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the mixture, counted for each target source."""
    t = _table(spark, sf, "mix_targets").select(F.lower(F.trim("source")).alias("source"), F.col("max_repeats").cast("long").alias("max_repeats"))
    docs = _table(spark, sf, "documents").select("doc_id", mixing.plain_source("source").alias("own"))
    drawn = p7_mix(spark, sf).join(docs, "doc_id", "left").join(t, "source", "left")
    faults = drawn.groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("foreign"), (F.count("*") - F.countDistinct("doc_id")).alias("twice"))
    return t.join(faults, "source", "left").na.fill(0, ["too_often", "foreign", "twice"])


def _targets(spark: SparkSession, sf: str) -> dict[str, tuple[float, int]]:
    return {r.source.strip().lower(): (r.target_share, r.max_repeats) for r in _table(spark, sf, "mix_targets").collect()}  # the setting, a row for each source


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(_sizes(spark, sf, "doc_id", "source"), "doc_id", "source", "tokens", _targets(spark, sf))
    return mixed.withColumn("tokenizer", F.lit(tokens.TOKENIZER))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf), _targets(spark, sf))


def p8_residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_table(spark, sf, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_residue(spark, sf).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_classes, p3_found, p3_terms, p5_found, p5_cover, p6_assignment, p6_fill, p6_checked, p7_mix, p7_shares, p7_checked, p8_found, p8_residue)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE)
