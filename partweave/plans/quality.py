"""Quality preview of an extract before anything is written (Q13)."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_text
from ..operators.process import process_records
from ..sources.extracts import raw_records, valid_rows


@dataclass
class Preview:
    summary: DataFrame
    categories: DataFrame
    abbreviations: DataFrame
    uom_issues: DataFrame
    samples: DataFrame


def missing_counts(rows: DataFrame, columns=("legacy_code", "description", "uom", "manufacturer", "part_number")):
    """One row: rows, valid rows, blanks per column and repeated codes (blank codes count as one code)."""
    blank = lambda c: F.count_if(F.length(F.coalesce(F.col(c), F.lit(""))) == 0)
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(valid_rows(rows)).alias("valid"),
        *[blank(c).alias(f"missing_{c}") for c in columns],
        (F.count("*") - F.countDistinct(F.coalesce("legacy_code", F.lit("")))).alias("in_file_duplicates"))


def preview_extract(mapped: DataFrame, org: str, ingested: DataFrame | None = None, samples: int = 6) -> Preview:
    described = process_records(mapped.filter(F.length(F.coalesce("description", F.lit(""))) > 0))
    hashes = raw_records(mapped, org, "preview").select("row_hash")
    known = hashes.limit(0) if ingested is None else ingested.filter(F.col("org") == org).select("row_hash").distinct().join(
        hashes, "row_hash", "left_semi")
    summary = missing_counts(mapped).crossJoin(known.agg(F.count("*").alias("already_ingested"))).crossJoin(
        described.agg(F.count_if(F.size("missing_required") > 0).alias("insufficient")))
    return Preview(
        summary,
        described.groupBy("category").agg(F.count("*").alias("n")),
        abbreviation_counts(described),
        uom_issue_counts(described),
        described.select("legacy_code", "description", "normalized", "category", "flags").limit(samples))


def abbreviation_counts(norm: DataFrame) -> DataFrame:
    return norm.select(F.explode("expansions").alias("e")).groupBy(F.col("e.term").alias("term")).agg(
        F.min("e.expansion").alias("expansion"), F.count("*").alias("n"))


def uom_issue_counts(norm: DataFrame) -> DataFrame:
    issues = norm.select(F.coalesce("uom", F.lit("∅")).alias("raw_uom"), "base_uom",
                         F.explode(F.filter("flags", lambda f: f.startswith("UOM_"))).alias("flag"))
    return issues.groupBy("raw_uom", "flag").agg(F.count("*").alias("n"), F.min("base_uom").alias("normalized_to"))
