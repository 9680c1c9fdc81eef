"""Rows that fail to parse: text columns, error arrays, and the split between them.

Every line is loaded as nullable text and cut into fields with array functions;
each rule is a column that gives a reason or null, and a line's error array
holds the reasons that apply, in the order of the rules. Lines with an empty
array come out as typed rows, the others with their first reason. All of it is
one pass of built-in expressions; only the check for repeated names shuffles,
on (file, name), with partial aggregation.

Defined results: a null line is ``columns``; a line of a format other than the
known ones, or of none, is ``format``; a name is a repetition if a faultless
line of the same file (null files are one file) with a smaller line number has
it, so lines without a number repeat nothing; an integer beyond 64 bits is
valid and typed as null, its text is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.plans.columns import take

_ESC = "\x01"


def quoted_fields(line: Column) -> tuple[Column, Column]:
    """(fields, whether the quoting is sound) of a comma-separated line.

    Between quotation marks lie, in turn, text outside and inside quoted
    fields; an empty stretch outside, with a mark on both sides, is a doubled
    mark. The quoting is sound if the marks are even in number and each stretch
    outside starts and ends at a comma or at an end of the line.
    """
    def hidden(parts: Column) -> Column:
        """The stretches put together, commas inside quotes hidden for the split."""
        last = F.size(parts) - 1

        def text(x: Column, i: Column) -> Column:
            plain = F.replace(x, F.lit(_ESC), F.lit(_ESC + "e"))
            return F.when(i % 2 == 1, F.replace(plain, F.lit(","), F.lit(_ESC + "c"))).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(plain)

        return F.array_join(F.transform(parts, text), "")

    def wrong(parts: Column) -> Column:
        last = F.size(parts) - 1

        def bad(x: Column, i: Column) -> Column:
            start = (i > 0) & ~x.startswith(",") & ~((i == last) & (x == ""))
            end = (i < last) & ~x.endswith(",") & ~((i == 0) & (x == ""))
            return (i % 2 == 0) & ~((x == "") & (i > 0) & (i < last)) & (start | end)

        return (last % 2 == 1) | F.exists(F.transform(parts, bad), lambda x: x)

    parts = F.split(line, '"', -1)
    fields = F.transform(F.split(_with(parts, hidden), ",", -1), lambda x: F.replace(F.replace(x, F.lit(_ESC + "c"), F.lit(",")), F.lit(_ESC + "e"), F.lit(_ESC)))
    return fields, ~_with(parts, wrong)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once, not again for each element of a loop in ``f``."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _field(fields: Column, n: int) -> Column:
    return F.get(fields, F.lit(n))


def _only(c: Column, letters: str) -> Column:
    """Not empty, and made of the letters alone."""
    return (c != "") & (F.translate(c, letters, "") == "")


#: The residue letters a line may hold.
RESIDUES = "ACGTUNRYSWKMBDHV"


_LETTERS = RESIDUES + RESIDUES.lower()
_TEXT = ("read_id_text", "name", "comment", "seq", "qual")


def _listed(rules: list[Column]) -> Column:
    """The reasons that apply; a null line has none but ``columns``."""
    return F.when(F.col("line").isNull(), F.array(F.lit("columns"))).otherwise(F.filter(F.array(*rules), lambda x: x.isNotNull()))


def _checked(rows: DataFrame, errors: Column, typed: dict[str, Column]) -> DataFrame:
    rows = rows.withColumn("errors", errors)
    none = {**{k: F.lit(None).cast("string") for k in _TEXT}, "tags": F.lit(None).cast("array<string>")}
    return rows.select("key", "source", "line_no", "kind", "line", "errors", *[F.when(F.size("errors") == 0, c).alias(k) for k, c in (none | typed).items()])


def _csv(rows: DataFrame) -> DataFrame:
    fields, sound = quoted_fields(F.col("line"))
    # A generator, so that no filter on what follows makes the optimiser cut each line several times.
    rows = rows.select("*", F.inline(F.array(F.struct(fields.alias("fields"), sound.alias("sound")))))
    read_id, name, comment, seq, qual = (_field(F.col("fields"), i) for i in range(5))
    printable = "".join(map(chr, range(ord("!"), ord("~") + 1)))
    bad_qual = (qual != "") & ((F.length(qual) != F.length(seq)) | (F.translate(qual, printable, "") != ""))
    rules = [
        F.when(~F.col("sound"), "quoting"),
        F.when(F.size("fields") != 5, "columns"),
        F.when(~_only(read_id, "0123456789"), "read_id"),
        F.when((name == "") | name.contains(" ") | name.contains("\t"), "name"),
        F.when(~_only(seq, _LETTERS), "seq"),
        F.when(bad_qual, "qual"),
    ]
    return _checked(rows, _listed(rules), {"read_id_text": read_id, "name": name, "comment": comment, "seq": seq, "qual": F.when(qual != "", qual)})


def _segments(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", F.inline(F.array(F.struct(F.split("line", "\t", -1).alias("tabs")))))
    tabs = F.col("tabs")
    name, seq = _field(tabs, 1), _field(tabs, 2)
    rules = [
        F.when((F.size(tabs) < 3) | (_field(tabs, 0) != "S"), "columns"),
        F.when((name == "") | name.contains(" "), "name"),
        F.when(~_only(seq, _LETTERS), "seq"),
    ]
    rows = _checked(rows, _listed(rules), {"name": name, "seq": seq, "tags": F.slice(tabs, 4, F.greatest(F.size(tabs) - 3, F.lit(0)))})
    # Names that faultless lines of one file repeat: few, and found with partial aggregation.
    file = lambda: (F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), F.col("name").alias("n"))
    first = rows.where(F.size("errors") == 0).groupBy(*file()).agg(F.min("line_no").alias("first_no"), F.count("*").alias("times")).where("times > 1").drop("times")
    same = (F.size("errors") == 0) & (F.coalesce("source", F.lit("")) == F.col("s")) & (F.col("source").isNull() == F.col("none")) & (F.col("name") == F.col("n"))
    rows = rows.join(first, same, "left")
    again = F.coalesce(F.col("line_no") > F.col("first_no"), F.lit(False))
    rows = rows.withColumn("errors", F.when(again, F.array(F.lit("duplicate_name"))).otherwise(F.col("errors")))
    return rows.select("key", "source", "line_no", "kind", "line", "errors", *[F.when(~again, F.col(k)).alias(k) for k in (*_TEXT, "tags")])


def parse_lines(df: DataFrame, key: str, source: str, line_no: str, kind: str, line: str) -> DataFrame:
    """Every line with its error array and its fields as text, null where there are errors.

    Each format is a scan of its own lines by its own rules; only segments, whose
    names must not repeat, are shuffled.
    """
    rows = take(df, key=key, source=source, line_no=line_no, kind=kind, line=line)
    other = rows.where("kind is null or kind not in ('reads_csv', 'gfa_s')")
    return _csv(rows.where("kind = 'reads_csv'")).unionByName(_segments(rows.where("kind = 'gfa_s'"))).unionByName(_checked(other, _listed([F.lit("format")]), {}))


def rejected(parsed: DataFrame) -> DataFrame:
    """(key, reason, line): the lines with a fault and the first reason that applies."""
    return parsed.where(F.size("errors") > 0).select("key", F.get("errors", F.lit(0)).alias("reason"), "line")


def accepted(parsed: DataFrame) -> DataFrame:
    """Typed rows of all other lines."""
    fine = parsed.where(F.size("errors") == 0)
    return fine.select("key", "source", "line_no", "kind", F.col("read_id_text").try_cast("bigint").alias("read_id"), "read_id_text", "name", "comment", "seq", "qual", "tags")
