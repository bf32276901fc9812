"""Bad rows beside the good ones: what a reader can't parse and what breaks a rule is kept with the reason.

good and rejected together are the input: nothing is dropped, and no bad row ends a job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.text import PAPER_TYPES
from strandgraph.sources.durable import stored

_CORRUPT, _REASONS = "_corrupt_record", "_reasons"
NOT_READABLE = "not readable"


@dataclass
class Parted:
    """good: rows that break no rule. rejected: (row, reasons), the row as it was read: a corrupt one as
    its text, another as JSON."""

    good: DataFrame
    rejected: DataFrame


def parted(rows: DataFrame, rules: dict[str, Column]) -> Parted:
    """rows by rules: a row is rejected for every rule whose condition is true of it; null is not true.

    Rows that a reader marked as corrupt (column _corrupt_record) are rejected as not readable alone, as
    their other columns say nothing. The rows are stored once, so that both parts are of one reading.
    """
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])).cast("array<string>")
    columns = [c for c in rows.columns if c != _CORRUPT]
    row = F.to_json(F.struct(*columns))
    if _CORRUPT in rows.columns:
        corrupt = F.col(_CORRUPT).isNotNull()
        broken = F.when(corrupt, F.array(F.lit(NOT_READABLE))).otherwise(broken)
        row = F.coalesce(_CORRUPT, row)
    marked = stored(rows.withColumn(_REASONS, broken))
    bad = F.size(_REASONS) > 0
    return Parted(marked.where(~bad).select(*columns), marked.where(bad).select(row.alias("row"), F.col(_REASONS).alias("reasons")))


def json_rows(spark: SparkSession, path: str, schema: str, rules: dict[str, Column] | None = None, whole_files: bool = False) -> Parted:
    """JSON lines, or files of one value each, as good and rejected rows."""
    rows = spark.read.schema(f"{schema}, {_CORRUPT} string").json(path, multiLine=whole_files, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    return parted(rows, rules or {})


def csv_rows(spark: SparkSession, path: str, schema: str, rules: dict[str, Column] | None = None) -> Parted:
    """CSV files with a header: rows with too many or too few values, or with one of another type, are rejected."""
    rows = spark.read.schema(f"{schema}, {_CORRUPT} string").csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    return parted(rows, rules or {})


def extraction_rules() -> dict[str, Column]:
    """What an extraction must not be."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return {
        "no paper_id": blank(F.col("paper_id")), "no title": blank(F.col("title")), "unknown paper_type": ~F.coalesce(F.col("paper_type").isin(*PAPER_TYPES), F.lit(False)),
        "no list of definitions": F.col("defines").isNull(), "a definition without a name": F.exists("defines", lambda d: blank(d["name"])),
    }
