"""Codes, numbers, masters and the registered queries of matching and governance against their oracle SQL."""
import duckdb
import pytest
from pyspark.sql import functions as F

from partweave import masters
from partweave.bindings import registry
from partweave.operators.govern import number_within, unique_codes, validate_decisions
from partweave.sources.tables import load_schemas


def test_numbers_split_a_common_prefix(spark):
    rows = spark.range(5000).select((F.col("id") % 2).cast("string").alias("g"), F.format_string("IN-MAT-%06d", "id").alias("code"))
    out = number_within(rows, "g", "code").collect()
    for g in ("0", "1"):
        got = [r["n"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["code"])]
        assert got == list(range(1, 2501))


@pytest.mark.parametrize("existing, expected", [
    (["X", "X-V3"], ["X-V2", "X-V4", "X-V5"]), ([], ["X", "X-V2", "X-V3"]), (["X-V2"], ["X", "X-V3", "X-V4"]),
    (["Y", "X-V1x"], ["X", "X-V2", "X-V3"])])
def test_first_free_codes(spark, existing, expected):
    new = spark.createDataFrame([("X", i) for i in range(3)], "code string, component int")
    old = spark.createDataFrame([(c,) for c in existing], "cnmc string")
    assert [r["cnmc"] for r in unique_codes(new, old).orderBy("component").collect()] == expected


def test_schema_rows_are_not_cut(spark):
    category = next(iter(masters.SCHEMAS))
    rows = spark.range(10_050).select(
        F.lit(category).alias("category"), F.concat(F.lit("k"), "id").alias("key"), F.lit("l").alias("label"), F.lit("g").alias("grp"),
        F.lit("text").alias("type"), F.lit(None).cast("string").alias("unit"), F.lit(1.0).alias("weight"), F.lit(False).alias("required"),
        F.lit(False).alias("identity"), F.lit(False).alias("veto"), F.lit(0.0).alias("tolerance"), F.col("id").alias("ordinal"),
        F.lit(True).alias("active"))
    assert len(load_schemas(rows)[category].fields) == 10_050


def test_batch_limit(spark):
    decisions = spark.createDataFrame([("a", "APPROVE", None, 1), ("b", "APPROVE", None, 1)],
                                      "pair_key string, action string, note string, decided_at int")
    recs = spark.createDataFrame([("a", "PENDING", False, "DUPLICATE")], "pair_key string, status string, vetoed boolean, match_type string")
    with pytest.raises(ValueError):
        validate_decisions(decisions, recs, max_batch=1)
    assert {r["error"] for r in validate_decisions(decisions, recs, 2).collect()} == {None, "Recommendation not found"}


@pytest.mark.parametrize("name", ["j1_block_pairs", "m8_match_type", "r2_insufficient_top3", "r4_collapsed_pairs",
                                  "r10_run_statistics", "g1_validated_decisions", "g6_free_codes", "w6_numbers"])
def test_query_equals_its_oracle(spark, sf_dir, name):
    queries, oracles = registry()
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries[name](spark, sf_dir).toPandas(), con.sql(oracles[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda frame: sorted(map(tuple, frame[columns].astype(str).values.tolist()))
    assert plain(got) == plain(want)
