"""Organisation extracts: CSV scan, header suggestion, column mapping, row identity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.text import SPACE, row_hash, trim_text

TARGETS = ["legacy_code", "description", "long_text", "uom", "manufacturer", "part_number", "material_group", "price",
           "qty"]
# Header patterns in the order in which they claim a header.
HEADER_RULES = [
    ("part_number", r"(?i)(mfr|manufacturer|oem).*(part|p/?n|no)|mpn|mfrpn|part\s*no"),
    ("manufacturer", r"(?i)^(mfr|make|manufacturer|mfr\s*name|oem|brand)"),
    ("legacy_code",
     r"(?i)(material|item|matl|mat)[\s._-]*(no|number|code|id)|^matnr$|legacy|^code$|item\s*code"),
    ("long_text", r"(?i)long|spec|basic\s*data|po\s*text|remarks"),
    ("description", r"(?i)desc|maktx|short\s*text|item\s*name|material\s*name"),
    ("uom", r"(?i)uom|unit|meins|base\s*u"),
    ("material_group", r"(?i)group|matkl|class"),
    ("price", r"(?i)price|rate|cost|value"),
    ("qty", r"(?i)qty|quantity|consumption|annual"),
]


def read_extract(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """S1 - all columns as strings, header names trimmed (a byte-order mark removed), blank lines dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8",
                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.length(trim_text(F.coalesce(F.col(f"`{c}`"), F.lit("")))) > 0)
    out = df.filter(filled)
    return out.withColumn("_file", F.col("_metadata.file_path")) if with_file else out


def suggest_mapping(headers: DataFrame, rules=HEADER_RULES) -> DataFrame:
    """S2 - headers(file, ordinal, header) -> (file, header, target) for any number of extracts at once.

    Rules claim headers one after the other: each takes the first header of a file that matches and is still free.
    Every file's headers are folded in a single aggregation of bounded size (one entry per header of one file)."""
    per_file = headers.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ordinal", "header"))).alias("hs"))
    start = F.transform("hs", lambda h: F.struct(
        h["ordinal"].cast("int").alias("ordinal"), h["header"].alias("header"),
        F.lit(None).cast("string").alias("target")))
    ruled = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(p).alias("pattern")) for t, p in rules])

    def claim(state: Column, rule: Column) -> Column:
        free = F.filter(state, lambda h: h["target"].isNull() & F.rlike(h["header"], rule["pattern"]))
        return let(F.get(free, F.lit(0))["ordinal"], lambda pick: F.transform(state, lambda h: F.struct(
            h["ordinal"].alias("ordinal"), h["header"].alias("header"),
            F.when(h["ordinal"] == pick, rule["target"]).otherwise(h["target"]).alias("target"))))

    out = per_file.select("file", F.aggregate(ruled, start, claim).alias("hs"))
    return out.select("file", F.explode("hs").alias("h")).select(
        "file", F.col("h.ordinal").alias("ordinal"), F.col("h.header").alias("header"), F.col("h.target").alias("target"))


def suggest_for(df: DataFrame) -> dict[str, str]:
    """Mapping of one extract; its header row is the only thing that is looked at."""
    spark = df.sparkSession
    rows = [("f", i, h) for i, h in enumerate(df.columns)]
    found = suggest_mapping(spark.createDataFrame(rows, "file string, ordinal int, header string"))
    return {r["header"]: r["target"] for r in found.filter("target is not null").collect()}


def clean_number(c: Column) -> Column:
    """'1,20,000' or '₹ 450' -> number; anything not finite is NULL."""
    n = F.regexp_replace(c, rf"(?:[,₹]|{SPACE})+", "").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """S3 - project onto the nine target fields and keep the original row as JSON payload."""
    inverse = {target: header for header, target in mapping.items() if target}
    source = lambda t: F.col(f"`{inverse[t]}`") if t in inverse else F.lit(None).cast("string")
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_file"]))
    cols = []
    for t in TARGETS:
        c = source(t)
        if t in ("legacy_code", "description"):
            c = trim_text(F.coalesce(c, F.lit("")))
        elif t in ("price", "qty"):
            c = clean_number(c)
        cols.append(c.alias(t))
    return df.select(*cols, payload.alias("payload"))


def valid_rows(rows: DataFrame) -> Column:
    """P1 - rows that can be ingested."""
    filled = lambda c: F.length(trim_text(F.coalesce(F.col(c), F.lit("")))) > 0
    return filled("legacy_code") & filled("description")


def raw_records(rows: DataFrame, org: str | Column, batch_id: str, ingested_at: str | Column | None = None) -> DataFrame:
    """Raw record columns of mapped rows: cleaned cells, content hash, deterministic record id."""
    org = F.lit(org) if isinstance(org, str) else org
    cell = lambda c: F.nullif(trim_text(F.col(c)), F.lit(""))
    at = F.current_timestamp() if ingested_at is None else (
        F.lit(ingested_at).cast("timestamp") if isinstance(ingested_at, str) else ingested_at)
    texts = ["long_text", "uom", "manufacturer", "part_number"]
    hashed = row_hash(org, *[F.col(c) for c in ("legacy_code", "description", *texts)])
    return rows.filter(valid_rows(rows)).select(
        hashed.alias("record_id"), org.alias("org"), F.lit(batch_id).alias("batch_id"),
        cell("legacy_code").alias("legacy_code"), cell("description").alias("description"),
        *[cell(c).alias(c) for c in texts], cell("material_group").alias("material_group"), "price", "qty", "payload",
        hashed.alias("row_hash"), at.alias("ingested_at"))
