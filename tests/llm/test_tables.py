"""URL lists, vectors, registration and the pipeline."""
import datetime as dt

import numpy as np
import pytest

from partweave.llm import embed_dups, queries, url_lists


def day(text):
    return dt.datetime.fromisoformat(text)


def test_url_lists(spark):
    events = spark.createDataFrame([
        ("bad", "domain", "Spam.example", "add", day("2024-01-10")), ("bad", "domain", "spam.example", "add", day("2024-01-20")),
        ("bad", "domain", "spam.example", "remove", day("2024-02-01")), ("good", "path", "a.spam.example/ok", "add", day("2024-01-15")),
        ("bad", "domain", "same.example", "add", day("2024-01-01")), ("bad", "domain", "same.example", "remove", day("2024-01-01")),
        (None, None, None, None, None)], "list_id string, scope string, key string, action string, at timestamp")
    captures = spark.createDataFrame([
        (1, "http://a.spam.example/x", day("2024-01-09")), (2, "http://A.SPAM.example:80/x", day("2024-01-10")),
        (3, "http://a.spam.example/ok/y?q", day("2024-01-16")), (4, "http://spam.example", day("2024-02-01")),
        (5, "http://notspam.example/", day("2024-01-16")), (6, None, day("2024-01-16")), (7, "", None), (8, "http://spam.example/", None),
        (9, "http://u@spam.example./", day("2024-01-31")), (10, "http://same.example/", day("2024-01-02"))],
        "page_id long, url string, fetched_at timestamp").selectExpr("*", "'k' as key", "1 as list_id")
    lists = {"bad": "block", "good": "allow"}
    found = {r["page_id"]: r["allowed"] for r in url_lists.url_verdicts(captures, events, lists).collect()}
    assert found == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True, 8: True, 9: False, 10: True}
    assert url_lists.url_verdicts(captures.limit(0), events, lists).count() == 0
    assert url_lists.url_verdicts(captures, events.limit(0), lists).filter("not allowed").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(600):
        v = centres[i % 12] + rng.normal(size=16) * (0.12 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in v], i % 4 if i % 50 else None))
    rows += [(600 + i, rows[5][1], 1) for i in range(4)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [], 1), (704, [1.0, None] * 8, 1), (705, [1.0] * 3, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as weight", "'v' as vector")
    found = {r["vec_id"]: r for r in embed_dups.near_duplicate_vectors(frame, pivots=64, block=50).collect()}
    usable = [(i, np.array(v), l) for i, v, l in rows if l is not None and v and len(v) == 16 and i < 700]
    links = {i: set() for i, *_ in rows}
    for a, (i, x, l) in enumerate(usable):
        for j, y, m in usable[a + 1:]:
            if l == m and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    true, got = sum(map(len, links.values())), sum(r["n_links"] for r in found.values())
    assert len(found) == len(rows) and 0.9 * true <= got <= true
    assert all(r["n_links"] <= len(links[i]) for i, r in found.items())
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(700, 706))
    assert embed_dups.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_registered():
    names, sql = queries.registry()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(sql) <= set(names)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(texts[2]) == set(texts[1]) == set(texts[3])
    last = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in last} == set(texts[3])


def test_oracle_sql_on_random_strings(spark, tmp_path):
    """The SQL of the secret scan, on texts where the battery decides something."""
    import random

    import duckdb
    import pandas as pd

    from partweave.llm import oracles

    draw = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [None, "", "é𝒳 token = 'abcdef12' x"]
    for i in range(80):
        size, alphabet = draw.choice([22, 36, 50, 120]), draw.choice([letters, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "Aa1b"])
        texts.append("ü " + "".join(draw.choice(alphabet) for _ in range(size)) + " and " + "Thing0" * (4 + i % 9))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    spark.createDataFrame(list(zip(range(len(texts)), texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_secret_scan(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(oracles.OP6).df()
    columns = sorted(got.columns)
    plain = lambda frame: sorted(map(tuple, frame[columns].astype(str).values.tolist()))
    assert plain(got) == plain(want) and got["spans"].str.contains("random").sum() > 20
