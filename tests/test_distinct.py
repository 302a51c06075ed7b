"""Costly columns are computed once for each combination of values, spread over the tasks, and reach every row."""
from pyspark.sql import functions as F

from partweave.operators.distinct import computed_once, with_computed
from partweave.operators.process import process_distinct, process_records

SCHEMA = "record_id int, description string, long_text string, uom string, manufacturer string, part_number string"


def test_values_are_computed_once_by_several_tasks_and_null_is_a_value(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 9 != 0, F.concat(F.lit("t"), F.col("id") % 40)).alias("text"),
                                   F.lit("old").alias("n"))
    found = computed_once(rows, ["text"], lambda df: df.withColumns({"n": F.length("text"), "task": F.spark_partition_id()}))
    assert found.count() == rows.select("text").distinct().count()
    assert found.select("task").distinct().count() > 1  # adaptive execution does not merge these few bytes into one task
    got = with_computed(rows, ["text"], found).select("id", "text", "n").collect()
    assert sorted((r.id, r.text, r.n) for r in got) == [
        (i, None if i % 9 == 0 else f"t{i % 40}", None if i % 9 == 0 else len(f"t{i % 40}")) for i in range(400)]


def test_processed_once_as_processed_one_by_one(spark):
    texts = [("BRG,DGBB,6205-2RS,C3", None), ("Hex Bolt M16x70 8.8 HDG", "ZINC"), (None, None), ("", "GASKET RING 5")]
    makers = [("EA", "SKF", "PN-1"), ("EA", "SKF", "PN-2"), (None, None, None), ("EA", None, "  ")]
    rows = spark.createDataFrame([(i, *texts[i % 4], *makers[i // 4 % 4]) for i in range(48)], SCHEMA)
    columns = ["record_id", "part_number", "category", "normalized", "fingerprint", "completeness", "base_uom"]
    shown = lambda df: sorted(df.select(*columns, F.to_json("attributes"), F.array_join("flags", ",")).collect(), key=lambda r: r[0])
    seen = []
    got = process_distinct(rows, lambda df: seen.append(df) or df)
    assert shown(got) == shown(process_records(rows))
    assert seen[0].count() == 12  # part numbers that are given differ in nothing else
