"""Columns of the caller that bear the operators' own names, and vectors of several dimensions."""
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from partweave.llm import bpe, embed_dups, pii, quality, suffix_dedup, url_lists

NAMES = ["_id", "_gone", "_kept", "_masked", "row", "gone", "kept", "masked", "removed_lines", "host", "line", "content", "ids", "n_words"]


@pytest.fixture(scope="module")
def clashing(spark):
    body = " ".join(f"word{i} some{i % 7}" for i in range(80))
    rows = [(1, body + " mail a.b@example.org"), (2, None), (3, "z" * 450), (4, body.upper()), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in NAMES])


@pytest.mark.parametrize("change", [quality.quality_filter, suffix_dedup.without_repeats, pii.mask_pii])
def test_other_columns_stay(spark, clashing, change):
    plain = {r["doc_id"]: r["text"] for r in change(clashing.select("doc_id", "text", "source")).collect()}
    out = change(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == plain
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES)
    if change is pii.mask_pii:
        assert "example.org" not in plain[1] and plain[2] is None


def test_outputs_replace_columns_of_their_name(spark, clashing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_documents(clashing, path, decoded="gone")
    assert coded.columns.count("ids") == coded.columns.count("gone") == 1
    assert all(r["gone"] == (r["text"] or "") for r in coded.collect())
    pages = clashing.select("*", F.lit("http://a.example.org/x").alias("url"), F.current_timestamp().alias("fetched_at"),
                            F.col("doc_id").alias("page_id"), F.lit("old").alias("blocked_by"))
    events = spark.createDataFrame([("l", "domain", "example.org", "add")], "list_id string, scope string, key string, action string").withColumn(
        "at", F.lit("2020-01-01").cast("timestamp"))
    for r in url_lists.url_verdicts(pages, events, {"l": "block"}).collect():
        assert r["host"] == "a.example.org" and r["blocked_by"] == "l|domain:example.org" and not r["allowed"]
        assert r["_id"] == f"_id-{r['doc_id']}"


def test_vectors_of_every_dimension_are_linked(spark):
    flat = [(i, [float(i % 17) - 8.2, float(i % 5) + 0.3], "x") for i in range(300)]
    odd = [(900, [1.0, 2.0, 3.0], "x"), (901, [1.0, 2.0, 3.0], "x"), (902, [2.0, 4.0, 6.1], "x"), (903, [1.0, 2.0, 3.0], "y"),
           (904, [3.0], "x"), (905, [5.0], "x"), (906, [-5.0], "x"), (907, [], "x"), (908, None, "x")]
    rows = spark.createDataFrame(flat + odd, "vec_id long, embedding array<double>, label string")
    out = {r["vec_id"]: r for r in embed_dups.near_duplicate_vectors(rows).collect()}
    assert [(out[i]["n_links"], out[i]["component_id"]) for i in range(900, 909)] == [
        (2, 900), (2, 900), (2, 900), (0, 903), (1, 904), (1, 904), (0, 906), (0, 907), (0, 908)]
    alone = {r["vec_id"]: r for r in embed_dups.near_duplicate_vectors(rows.filter("vec_id < 900")).collect()}
    assert all(out[i] == alone[i] for i in alone)
