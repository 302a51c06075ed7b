"""What one task reads and what is shuffled, counted from Spark's own stage metrics."""
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from partweave.operators.groups import GroupTable, placed
from partweave.plans.views import lookup_codes


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def shuffle_reads(spark, run, what="recordsRead"):
    """Records (or bytes) that each task of each stage of ``run`` read from shuffles: a list of lists, and the value of ``run``."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.range(1).collect()
    stages = lambda: {s.stageId(): s for s in _seq(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(
        spark.sparkContext._jvm.double, 0), None))}
    known, value = set(stages()), run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    out = []
    for number, s in stages().items():
        if number not in known and s.status().toString() == "COMPLETE":
            tasks = _seq(store.taskList(number, s.attemptId(), 10_000))
            out.append([getattr(t.taskMetrics().get().shuffleReadMetrics(), what)() for t in tasks])
    return out, value


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def test_code_lookup_deals_records_without_a_code_over_all_tasks(spark):
    n = 4000
    raw = spark.range(n).select(F.lit("CPCL").alias("org"), F.concat(F.lit("L"), "id").alias("legacy_code"), F.concat(
        F.lit("r"), "id").alias("record_id")).union(spark.createDataFrame([("IOCL", "L0", "x0")], "org string, legacy_code string, record_id string"))
    mappings = spark.createDataFrame(
        [("r0", "C1", "CPCL", "L0", "ACTIVE"), ("x0", "C1", "IOCL", "L0", "ACTIVE"), ("r1", "C2", "CPCL", "L1", "REVERSED"), ("r2", "C3", "CPCL", "L2", "ACTIVE")],
        "record_id string, cnmc string, org string, legacy_code string, status string").withColumns({
            "match_type": F.lit("DUPLICATE"), "confidence": F.lit(0.9)})
    canonical = spark.createDataFrame([("C1", "S1", "one"), ("C2", "S2", "two")], "cnmc string, short_code string, description string")
    asked = raw.select(F.lower("org").alias("org"), "legacy_code").union(spark.createDataFrame([("cpcl", "none")], "org string, legacy_code string"))
    with settings(spark, **PLAIN):
        reads, rows = shuffle_reads(spark, lambda: lookup_codes(asked, raw, mappings, canonical).collect())
    got = {(r["org"], r["legacy_code"]): (r["status"], r["record_id"], r["cnmc"], r["short_code"], r["siblings"]) for r in rows}
    assert len(rows) == len(got) == n + 2
    assert got["CPCL", "L0"] == ("HARMONISED", "r0", "C1", "S1", ["IOCL:L0"]) and got["IOCL", "L0"][4] == ["CPCL:L0"]
    assert got["CPCL", "L1"] == ("NOT_YET_HARMONISED", "r1", None, None, []) and got["CPCL", "none"] == ("NOT_FOUND", None, None, None, [])
    assert got["CPCL", "L2"] == ("HARMONISED", "r2", "C3", None, [])
    large = [r for r in reads if sum(r) > n / 2]
    assert large and all(max(r) < 0.5 * sum(r) for r in large)


def copied(spark, sf_dir, path, times):
    """Parts and their line items ``times`` times over, with shifted keys; the texts of the records repeat."""
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        t.crossJoin(spark.range(times).select(F.col("id").alias("_copy"))).withColumn(key, F.col(key) + F.col("_copy") * 1_000_000).drop(
            "_copy").write.parquet(f"{path}/{name}.parquet")
    for name in ("supplier", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["k7_trigram_search", "k7_prefix_search"])
def test_search_shuffles_a_row_a_record_and_no_grams_of_copies(spark, sf_dir, tmp_path, name):
    from partweave.bindings import registry
    from partweave.bindings.base import Domain

    query, large = registry()[0][name], copied(spark, sf_dir, tmp_path, 8)
    n = Domain(spark, large).raw.count()
    once = sorted((r["request_id"], r["sim"]) for r in query(spark, sf_dir).collect())
    reads, rows = shuffle_reads(spark, lambda: query(spark, large).collect())
    assert once and sorted((r["request_id"], r["sim"]) for r in rows) == sorted(once * 8)
    assert len({(r["request_id"], r["record_id"]) for r in rows}) == len(rows)
    assert sum(map(sum, reads)) < 12 * n, sum(map(sum, reads)) / n


def test_a_batch_of_groups_shuffles_few_times_the_bytes_of_its_ids(spark, tmp_path):
    long_id = lambda i: F.concat_ws("", *[F.sha2(F.concat(F.lit(f"{k}-"), i), 256) for k in range(4)])  # 256 characters
    links = spark.range(2000).select(long_id((F.col("id") * 2).cast("string")).alias("a"), long_id((F.col("id") * 2 + 1).cast("string")).alias("b"))
    groups = GroupTable(spark, f"{tmp_path}/groups", buckets=4)
    with settings(spark, **PLAIN):
        reads, _ = shuffle_reads(spark, lambda: groups.add(links), "localBytesRead")
    assert groups.read().count() == 4000
    assert sum(map(sum, reads)) < 10 * 4000 * 256, sum(map(sum, reads)) / (4000 * 256)


def test_ids_that_share_a_hash_do_not_share_a_group(spark):
    links = spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("d", "e", 2), ("f", "f", 3)], "a string, b string, link bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    few = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    right = [(n, False, g) for n, g in zip("abcdef", "aaaddf")]
    assert rows(placed(links, None)) == right and rows(placed(links, None, [few, F.xxhash64])) == right
    with pytest.raises(RuntimeError):
        placed(links, None, [few])
