"""Masters over time and the ingest stream, as whole programs."""
from partweave.operators.govern import batch_status, revise_dictionary
from partweave.streaming.incremental import RAW_SCHEMA, file_source, ingest_stream


def test_dictionary_and_batches_over_time(spark):
    entries = spark.createDataFrame([("VLV", None, "VALVE", "ABBREVIATION", 1, True), ("GT", "VALVE", "GATE", "ABBREVIATION", 2, True)],
                                    "term string, category string, expansion string, kind string, version int, active boolean")
    changes = spark.createDataFrame([("vlv", None, "valve", "ABBREVIATION", 1), ("gt", "VALVE", "GATE TYPE", "ABBREVIATION", 2),
                                     ("gt", "VALVE", "GATE", "ABBREVIATION", 3), ("new", None, "term", "SYNONYM", 4)],
                                    "term string, category string, expansion string, kind string, changed_at int")
    after, outcomes = revise_dictionary(entries, changes)
    assert sorted((r["term"], r["outcome"]) for r in outcomes.collect()) == [
        ("GT", "REVISED"), ("GT", "REVISED"), ("NEW", "ADDED"), ("VLV", "REJECTED_IDENTICAL")]
    live = {(r["term"], r["version"]): r["expansion"] for r in after.filter("active").collect()}
    assert live == {("VLV", 1): "VALVE", ("GT", 4): "GATE", ("NEW", 1): "TERM"}
    events = spark.createDataFrame([("b1", "INGESTED", 1), ("b1", "MATCHED", 2), ("b1", "CLASSIFIED", 2), ("b2", "INGESTED", 1)], "batch_id string, status string, at int")
    assert {r["batch_id"]: r["status"] for r in batch_status(events).collect()} == {"b1": "MATCHED", "b2": "INGESTED"}


def test_stream_is_replayed_without_new_rows(spark, tmp_path):
    rows = lambda lo, hi: [(f"CPCL", f"M{i}", f"BRG,DGBB,62{i:02d}", None, "EA", None, None, None, 1.0, 1.0) for i in range(lo, hi)]
    put = lambda name, part: spark.createDataFrame(part, RAW_SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    put("one", rows(0, 5))
    seen = []
    start = lambda check: ingest_stream(file_source(spark, f"{tmp_path}/in"), f"{tmp_path}/raw", check, after=lambda t, b: seen.append((b, t.count())))
    start(f"{tmp_path}/c1").awaitTermination(120)
    put("two", rows(3, 8))
    start(f"{tmp_path}/c1").awaitTermination(120)
    assert seen == [("batch-000000000", 5), ("batch-000000001", 8)]
    # A stream that lost its progress reads everything again and writes its first batch anew.
    start(f"{tmp_path}/c2").awaitTermination(120)
    held = spark.read.parquet(f"{tmp_path}/raw")
    assert held.count() == held.select("row_hash").distinct().count() == 8
