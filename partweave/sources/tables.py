"""Parquet tables of the engine: idempotent append, keyed upsert, EAV overwrite, config overlay."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import masters
from ..functions.text import file_hash
from ..operators.extract import explode_attributes
from .extracts import raw_records, valid_rows

OPEN = ["PENDING", "NEEDS_INFO"]


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and bool(fs.globStatus(jvm.org.apache.hadoop.fs.Path(os.path.join(path, "*"))))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """S4 - filter and columns reach the parquet scan."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def new_rows(rows: DataFrame, target: DataFrame | None) -> DataFrame:
    """Rows of a batch that the target does not hold yet; equal rows inside the batch count once."""
    unique = rows.dropDuplicates(["row_hash"])
    return unique if target is None else unique.join(target.select("row_hash"), "row_hash", "left_anti")


def ingest_rows(mapped: DataFrame, org: str, batch_id: str, target_path: str, ingested_at: str | None = None) -> DataFrame:
    """S7 - append what is new and return the one-row batch ledger entry."""
    spark = mapped.sparkSession
    rows = raw_records(mapped, org, batch_id, ingested_at)
    target = spark.read.parquet(target_path) if table_exists(spark, target_path) else None
    fresh = new_rows(rows, target).cache()
    totals = mapped.agg(F.count("*").alias("row_count"), F.count_if(valid_rows(mapped)).alias("valid")).crossJoin(
        rows.agg(file_hash(F.col("row_hash")).alias("file_hash"))).crossJoin(
        fresh.agg(F.count("*").alias("inserted")))
    entry = totals.select(
        F.lit(batch_id).alias("batch_id"), F.lit(org).alias("org"), "file_hash", "row_count", "inserted",
        (F.col("valid") - F.col("inserted")).alias("skipped"), (F.col("row_count") - F.col("valid")).alias("rejected"),
        F.lit("INGESTED").alias("status"))
    ledger_row = spark.createDataFrame(entry.collect(), entry.schema)   # one row; fixed before the append changes it
    fresh.write.mode("append").parquet(target_path)
    fresh.unpersist()
    return ledger_row


def upsert_recommendations(existing: DataFrame, incoming: DataFrame, key: str = "pair_key") -> DataFrame:
    """S8 - snapshot after the upsert: open rows take the new values, decided rows stay, unknown keys are inserted."""
    cols = [c for c in existing.columns if c != key]
    new = incoming.select(key, F.lit(True).alias("_new"), *[
        (F.col(c) if c in incoming.columns else F.lit(None).cast(existing.schema[c].dataType)).alias(f"_n_{c}")
        for c in cols])
    old = existing.withColumn("_old", F.lit(True))
    joined = old.join(new, key, "full")
    is_open = F.coalesce(F.col("_old"), F.lit(False)) & F.col("status").isin(OPEN)
    take_new = F.coalesce(F.col("_new"), F.lit(False)) & (F.col("_old").isNull() | is_open)
    keep = {"status"}
    value = lambda c: F.when(take_new & F.col("_old").isNull(), F.coalesce(F.col(f"_n_{c}"), F.lit("PENDING"))).otherwise(
        F.col(c)) if c in keep else F.when(take_new, F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(key, *[value(c).alias(c) for c in cols])


def write_attributes(records: DataFrame, path: str, batch_col: str = "batch_id") -> None:
    """S9 - attribute rows of processed records; only the partitions of the written batches are replaced."""
    rows = explode_attributes(records, "record_id").join(records.select("record_id", batch_col), "record_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).parquet(path)


def load_schemas(overrides: DataFrame | None) -> dict[str, masters.CategorySchema]:
    """S5 - default family schemas with the active rows of a configuration table on top.

    The table has one row per schema field (category, key, label, grp, type, unit, weight, required, identity, veto,
    tolerance, ordinal, active); a family present there replaces its default field list.  Its size is the number of
    schema fields."""
    out = dict(masters.SCHEMAS)
    if overrides is None:
        return out
    rows = sorted(_bounded(overrides.filter("active")), key=lambda r: (r["category"], r["ordinal"]))
    for category in sorted({r["category"] for r in rows}):
        base = masters.SCHEMAS[category]
        fields = tuple(
            masters.Field(r["key"], r["label"], r["grp"], r["type"], r["unit"], float(r["weight"]), r["required"],
                          r["identity"], r["veto"], float(r["tolerance"] or 0)) for r in rows if r["category"] == category)
        out[category] = masters.replace(base, fields=fields)
    return out


def load_config(overrides: dict | None) -> masters.EngineConfig:
    """S5 - engine defaults with given values on top; checked on construction."""
    return masters.DEFAULT_CONFIG.with_(**(overrides or {}))


def load_dictionary(entries: DataFrame) -> list[masters.DictionaryEntry]:
    """S6 - active dictionary entries (the master is a few hundred rows; more than 50,000 is refused)."""
    return [masters.DictionaryEntry(r["term"], r["expansion"], r["kind"], r["category"])
            for r in _bounded(entries.filter("active").select("term", "expansion", "kind", "category"))]


def load_rules(rules: DataFrame) -> list[tuple]:
    """S6 - active substitution rules."""
    return [tuple(r) for r in _bounded(rules.filter("active").select(
        "category", "attribute_key", "from_value", "to_value", "bidirectional", "rationale"))]


def load_uoms(uoms: DataFrame) -> list[tuple]:
    """S6 - unit master."""
    return [(r["code"], r["name"], r["dimension"], r["base_code"], r["factor"], r["iso_code"], list(r["aliases"]))
            for r in _bounded(uoms)]


def _bounded(df: DataFrame, limit: int = 50_000) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"master table has more than {limit} rows")
    return rows
