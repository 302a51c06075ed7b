"""KNN, components, Jaro-Winkler, ledger and embedding against brute force on small inputs."""
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from partweave.functions.similarity import jaro_winkler, jaro_winkler_arrays, levenshtein_ratio, trigram_similarity
from partweave.operators.components import connected_components
from partweave.operators.embed import embed_tokens, fnv1a32
from partweave.operators.knn import knn_join
from partweave.operators.ledger import (chain_events, seal_segments, segment_heads, verify_chain, verify_segments)


def brute_jw(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = set(), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if j not in used and b[j] == ch:
                used.add(j)
                left.append(ch)
                break
    m = len(left)
    if m == 0:
        return 0.0
    right = [b[j] for j in sorted(used)]
    t = sum(x != y for x, y in zip(left, right))
    jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


def test_jaro_winkler_matches_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ABC 1é") for _ in range(rng.randint(0, 40)))
    left, right = [word() for _ in range(3000)], [word() for _ in range(3000)]
    want = np.array([brute_jw(a, b) for a, b in zip(left, right)])
    assert np.abs(jaro_winkler_arrays(left, right) - want).max() < 1e-12
    df = spark.createDataFrame(list(zip(left[:50], right[:50])) + [(None, "A")], "a string, b string")
    got = [r[0] for r in df.select(jaro_winkler("a", "b")).collect()]
    assert np.abs(np.array(got[:50]) - want[:50]).max() < 1e-12 and got[50] is None


def _brute_knn(rows, k):
    out = {}
    for i, g, v in rows:
        sims = []
        for j, h, w in rows:
            if i != j and g == h:
                c = float(np.round(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 9))
                sims.append((-c, j))
        out[i] = [j for _, j in sorted(sims)[:k]]
    return out


def test_knn_is_exact_with_many_cells_and_hot_groups(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        g = "hot" if i < 400 else f"g{i % 5}"
        centre = np.eye(12)[i % 7] * 2
        rows.append((i, g, [float(x) for x in centre + rng.normal(size=12) * (0.05 if i % 2 else 1.0)]))
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>").repartition(3)
    want = _brute_knn(rows, 4)
    for per_pivot, tile in ((2048, 2000), (2048, 50), (8, 60)):
        got = {}
        near = knn_join(df, "id", "grp", "v", 4, tile=tile, per_pivot=per_pivot)
        for r in near.orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["neighbor_id"])
        assert got == {k: v for k, v in want.items() if v}


def test_components_of_chain_star_and_isolated(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    edges += [("hub", f"h{i}") for i in range(50)] + [("x", "x")]
    df = spark.createDataFrame(edges, "a string, b string")
    nodes = spark.createDataFrame([("alone",), ("x",)], "node string")
    got = {r["node"]: r["component"] for r in connected_components(df, vertices=nodes).collect()}
    assert {v for k, v in got.items() if k[0] == "c"} == {"c000"}
    assert {got[f"h{i}"] for i in range(50)} == {"h0"} and got["hub"] == "h0"
    assert got["alone"] == "alone" and got["x"] == "x" and len(got) == 121 + 51 + 2


def test_ledger_chain_and_tampering(spark):
    rows, prev, out = [], "0" * 64, []
    for i in range(1, 60):
        if i % 7 == 0:
            continue                                   # gaps are legal
        body = f'{{"n":{i}}}'
        h = hashlib.sha256(f"{prev}|{body}".encode()).hexdigest()
        out.append((i, body, prev, h))
        prev = h
    cols = "seq long, body string, prev_hash string, hash string"
    good = verify_chain(spark.createDataFrame(out, cols).repartition(3), span=5).first()
    assert good.ok and good.checked == len(out) and good.head_hash == prev
    for i, change in ((10, (1, "{}")), (30, (2, "f" * 64)), (11, (3, "0" * 64))):
        bad = [list(r) for r in out]
        bad[i][change[0]] = change[1]
        r = verify_chain(spark.createDataFrame(bad, cols), span=5).first()
        assert not r.ok and r.broken_at_seq == out[i][0] and r.message == f"Chain broken at event #{out[i][0]}"
    gone = [r for k, r in enumerate(out) if k != 20]
    assert verify_chain(spark.createDataFrame(gone, cols), span=5).first().broken_at_seq == out[21][0]

    events = spark.createDataFrame([(i, f'{{"n":{i}}}') for i in range(95)], "seq long, body string")
    led = chain_events(events, segment_size=10)
    seg = {r.seq: r for r in led.collect()}
    seed = hashlib.sha256(("0" * 64 + "|main|3").encode()).hexdigest()
    assert seg[30].prev_hash == seed and seg[31].prev_hash == seg[30].hash
    assert seg[30].hash == hashlib.sha256(f'{seed}|{{"n":30}}'.encode()).hexdigest()
    assert verify_segments(led, segment_size=10).first().ok
    seal = seal_segments(segment_heads(led), fanout=4).collect()
    assert len(seal) == 1 and seal[0].levels == 2
    other = led.withColumn("body", F.when(F.col("seq") == 42, "x").otherwise(F.col("body")))
    assert verify_segments(other, segment_size=10).first().broken_at_seq == 42


def test_embedding_and_hash(spark):
    df = spark.createDataFrame([(["VALVE", "GATE", "100", "VALVE"],), ([],)], "t array<string>")
    rows = [r[0] for r in df.select(embed_tokens("t")).collect()]
    assert len(rows[0]) == 256 and abs(sum(x * x for x in rows[0]) - 1) < 1e-4 and set(rows[1]) == {0.0}
    assert spark.range(1).select(fnv1a32(F.lit("foobar"))).first()[0] == 0xBF9CF968


def test_small_similarities(spark):
    r = spark.range(1).select(
        levenshtein_ratio(F.lit("kitten"), F.lit("sitting")).alias("l"),
        levenshtein_ratio(F.lit(""), F.lit("")).alias("e"),
        trigram_similarity(F.lit("word"), F.lit("two words")).alias("t")).first()
    assert abs(r.l - (1 - 3 / 7)) < 1e-12 and r.e == 1.0 and abs(r.t - 4 / 11) < 1e-12
