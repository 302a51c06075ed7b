"""Incremental ingest and per-batch matching as Structured Streaming jobs."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.process import process_records
from ..plans.matching import run_matching
from ..sources.tables import new_rows, table_exists

RAW_SCHEMA = ("org string, legacy_code string, description string, long_text string, uom string, manufacturer string, "
              "part_number string, material_group string, price double, qty double")


def _with_identity(rows: DataFrame) -> DataFrame:
    from ..functions.text import row_hash

    h = row_hash(F.col("org"), *[F.col(c) for c in ("legacy_code", "description", "long_text", "uom", "manufacturer",
                                                   "part_number")])
    return rows.withColumns({"row_hash": h, "record_id": h})


def ingest_stream(source: DataFrame, target_path: str, checkpoint: str,
                  after: Callable[[DataFrame, str], None] | None = None) -> StreamingQuery:
    """Z1 - append the rows of every micro-batch that the target does not hold yet.

    The rows of a batch carry its id and go to their own partition, which is overwritten when a batch is replayed after a
    failure: replay gives the same table, so ingest stays idempotent end to end."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch_id = f"batch-{epoch:09d}"
        rows = _with_identity(batch.filter("trim(legacy_code) <> '' and trim(description) <> ''"))
        held = None
        if table_exists(spark, target_path):
            held = spark.read.parquet(target_path).filter(F.col("batch_id") != batch_id)
        fresh = new_rows(rows, held).withColumn("batch_id", F.lit(batch_id))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
            target_path)
        if after is not None:
            after(spark.read.parquet(target_path), batch_id)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def match_batch(table: DataFrame, batch_id: str, out_path: str) -> None:
    """Z2 - process the table, match the records of one batch against everything, write its recommendations."""
    run = run_matching(process_records(table), batch_id=batch_id)
    run.recommendations.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path)


def file_source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
