"""One object for the whole way: align reads, add more, take the result, write it."""

from __future__ import annotations

import resource
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.kernels.params import Params
from braidwork.operators import poa
from braidwork.plans.lineage import written
from braidwork.streaming import incremental

Reads = "DataFrame | Sequence[str]"


class Result:
    """The groups' graphs, rows and consensus sequences; ``frame`` has one row a group."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def part(self, name: str) -> DataFrame:
        return poa.part(self.frame, name)

    @property
    def consensus(self) -> DataFrame:
        return self.part("consensus")

    @property
    def rows(self) -> DataFrame:
        return self.part("msa")

    def lines(self, mode: int) -> DataFrame:
        return poa.lines(self.frame, mode)

    def write(self, path: str, mode: int) -> None:
        """One file a group."""
        poa.write_lines(self.lines(mode), path)

    def of_one(self) -> dict:
        """All there is of a single group, for reads given as a list."""
        some = self.frame.limit(2).collect()
        if len(some) != 1:
            raise ValueError("the result is not one group")
        r = some[0]
        return {
            "n_seq": r.n_seq, "n_cons": len(r.consensus), "cons_seq": [c.seq for c in r.consensus], "cons_cov": [list(c["cov"]) for c in r.consensus], "cons_qv": [c.qual for c in r.consensus],
            "clu_read_ids": [list(c.clu_read_ids) for c in r.consensus], "msa_len": r.n_columns, "msa_seq": [m.aligned for m in r.msa] + [c.aligned for c in r.consensus],
        }


class Aligner:
    """Keeps the graphs between calls. Reads are a table (group_id, read_id, name, seq, qual) or the sequences of one group."""

    def __init__(self, spark: SparkSession, params: Params | None = None, **settings):
        self.spark, self.params = spark, (params or Params()).with_(**settings)
        self.state: DataFrame | None = None

    def _table(self, reads, quals, first: int) -> tuple[DataFrame, str | None]:
        if isinstance(reads, DataFrame):
            return reads, "weights" if "weights" in reads.columns else None
        if isinstance(reads, str):
            raise TypeError("reads must be a list of sequences or a table, not one string")
        quals = quals or [None] * len(reads)
        if len(quals) != len(reads):
            raise ValueError("as many qualities as reads are needed")
        text = all(q is None or isinstance(q, str) for q in quals)
        kind = "qual string" if text else "weights array<int>"
        rows = [("0", first + i, s, q) for i, (s, q) in enumerate(zip(reads, quals))]
        df = self.spark.createDataFrame(rows, f"group_id string, read_id int, seq string, {kind}").withColumn("name", F.lit(None).cast("string"))
        return (df if text else df.withColumn("qual", F.lit(None).cast("string"))), None if text else "weights"

    def msa(self, reads, quals=None, parts: tuple[str, ...] = poa.PARTS) -> Result:
        """All reads at once, nothing kept."""
        df, weights = self._table(reads, quals, 0)
        return Result(poa.poa(df, self.params, parts, weights=weights))

    def align(self, reads, quals=None) -> Aligner:
        """Starts anew with these reads."""
        self.state = None
        return self._add(reads, quals)

    def add(self, reads, quals=None, nodes: tuple[str, str] | None = None) -> Aligner:
        """More reads for the graphs there are. ``nodes``: see ``incremental.add``."""
        if self.state is None:
            raise ValueError("there are no reads to add to; align or restore first")
        return self._add(reads, quals, nodes)

    def restore(self, lines: DataFrame | None = None, rows: DataFrame | None = None) -> Aligner:
        """Graphs from written lines (group_id, line_no, line) or aligned rows (group_id, read_id, name, aligned)."""
        if (lines is None) == (rows is None):
            raise ValueError("lines or rows, one of them")
        self.state = incremental.from_gfa(lines, self.params) if lines is not None else incremental.from_aligned(rows, self.params, name="name" if "name" in rows.columns else None)
        return self

    def output(self, parts: tuple[str, ...] = poa.PARTS) -> Result:
        if self.state is None:
            raise ValueError("there are no reads")
        return Result(incremental.finish(self.state, self.params, parts))

    def _add(self, reads, quals, nodes: tuple[str, str] | None = None) -> Aligner:
        n = 0
        if not isinstance(reads, DataFrame) and self.state is not None:
            n = self.state.agg(F.max("n_seq")).first()[0] or 0
        df, weights = self._table(reads, quals, n)
        self.state = written(incremental.add(self.state, df, self.params, weights=weights, nodes=nodes), "state")
        return self


def run(reads: DataFrame, mode: int, path: str, params: Params = Params()) -> dict[str, float]:
    """Aligns, writes the lines of a mode (one file a group) and reports: groups, reads, letters, seconds, CPU seconds and peak memory of the driver."""
    began, cpu = time.time(), time.process_time()
    seen = reads.agg(F.countDistinct("group_id"), F.count("*"), F.sum(F.length("seq"))).first()
    result = poa.poa(reads, params, poa.MODES[mode])
    poa.write_lines(poa.lines(result if mode in (0, 5) else written(result, "result"), mode), path)
    return {"groups": seen[0], "reads": seen[1], "letters": seen[2] or 0, "seconds": time.time() - began, "cpu_seconds": time.process_time() - cpu, "peak_gb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1 << 20)}
