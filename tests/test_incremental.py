"""State kept between batches: equal to a full recomputation, and touching only what a batch concerns."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partweave.functions.similarity import trigrams
from partweave.operators.components import connected_components
from partweave.operators.groups import GroupTable
from partweave.operators.knn import knn_join
from partweave.operators.knn_index import KnnIndex
from partweave.operators.setjoin import candidates, set_index, similar_sets
from partweave.sources.buckets import BucketedTable, VersionConflict
from partweave.sources.key_index import KeyIndex
from partweave.sources.tables import upsert_recommendations

PAIRS = "pair_key string, score double, status string"


def rows(frame):
    return sorted(map(tuple, frame.collect()))


# S8
def test_upsert_touches_only_its_buckets(spark, tmp_path):
    kept = BucketedTable(spark, f"{tmp_path}/pairs", "pair_key", buckets=8)
    assert kept.read() is None and kept.version() == 0
    first = [(f"p{i}", i / 100, "PENDING" if i % 2 else "APPROVED") for i in range(200)]
    kept.upsert(spark.createDataFrame(first, PAIRS))
    before = kept.files()
    new = spark.createDataFrame([("p1", 9.0, None), ("p2", 9.0, None), ("fresh", 9.0, None)], PAIRS)
    touched = {r[0] for r in new.select(kept.place).collect()}
    kept.upsert(new, merge=upsert_recommendations)
    after = kept.files()
    assert {b for b in before if before[b] != after.get(b)} == touched & set(before) and len(touched) < 8
    expected = upsert_recommendations(spark.createDataFrame(first, PAIRS), new)
    assert rows(kept.read()) == rows(expected)
    assert rows(kept.read(version=1)) == sorted(first)


def test_a_killed_write_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    kept = BucketedTable(spark, f"{tmp_path}/pairs", "pair_key", buckets=4)
    kept.upsert(spark.createDataFrame([("a", 1.0, "PENDING")], PAIRS))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(kept, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            kept.upsert(spark.createDataFrame([("a", 2.0, "PENDING"), ("b", 2.0, "PENDING")], PAIRS))
    assert rows(kept.read()) == [("a", 1.0, "PENDING")]
    kept.folder.create("versions/000000000002", '{"schema": ')  # cut off while it was written
    assert rows(kept.read()) == [("a", 1.0, "PENDING")]
    kept.upsert(spark.createDataFrame([("b", 3.0, "PENDING")], PAIRS))
    assert rows(kept.read()) == [("a", 1.0, "PENDING"), ("b", 3.0, "PENDING")] and kept.version() == 3
    kept.vacuum(keep=1)
    assert rows(kept.read()) == [("a", 1.0, "PENDING"), ("b", 3.0, "PENDING")]


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = [BucketedTable(spark, f"{tmp_path}/pairs", "pair_key", buckets=4) for _ in range(2)]
    one.upsert(spark.createDataFrame([("a", 1.0, "PENDING")], PAIRS))
    base = two.state()
    one.upsert(spark.createDataFrame([("b", 1.0, "PENDING")], PAIRS))
    with pytest.raises(VersionConflict):
        two.commit(base, base["version"])
    assert len(rows(one.read())) == 2


def test_upsert_of_nothing_and_of_null_keys(spark, tmp_path):
    kept = BucketedTable(spark, f"{tmp_path}/pairs", "pair_key", buckets=4)
    kept.upsert(spark.createDataFrame([], PAIRS))
    assert kept.read().count() == 0
    kept.upsert(spark.createDataFrame([(None, 1.0, "PENDING"), ("a", 1.0, None)], PAIRS).withColumn("bucket", F.lit(7)))
    assert kept.read().count() == 2 and "bucket" in kept.read().columns


# S7
def test_key_index_equals_the_anti_join(spark, tmp_path):
    index, seen, draw = KeyIndex(spark, f"{tmp_path}/keys", "k", buckets=8), set(), random.Random(3)
    for turn in range(4):
        batch = [draw.randrange(900) for _ in range(300)]
        frame = spark.createDataFrame([(f"key{i}", i) for i in batch] + [(None, -1)], "k string, n int")
        fresh = index.unseen(frame)
        got = sorted(r["n"] for r in fresh.collect())
        assert got == sorted([i for i in batch if i not in seen] + [-1])
        index.add(fresh, f"batch-{turn}")
        seen |= set(batch)
    assert rows(index.unseen(spark.createDataFrame([("key1", 1)], "k string, n int"))) == ([] if 1 in seen else [("key1", 1)])
    assert index.compact(most=2) == 1
    again = spark.createDataFrame([(f"key{i}", i) for i in range(900)], "k string, n int")
    assert sorted(r["n"] for r in index.unseen(again).collect()) == sorted(set(range(900)) - seen)


def test_key_index_opens_few_files(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/keys", "k", buckets=16)
    keys = lambda a, b: spark.range(a, b).select(F.concat(F.lit("key"), "id").alias("k"))
    for turn in range(3):
        index.add(keys(1000 * turn, 1000 * turn + 1000), f"batch-{turn}")
    new = keys(10_000, 10_040)
    assert index.unseen(new).count() == 40 and len(index.opened) <= 4  # of 48 files
    index.unseen(keys(1500, 1501))
    assert len(index.opened) <= 2
    # A batch that is written again does not stand in its own way.
    assert index.unseen(keys(0, 1000), besides="batch-0").count() == 1000
    index.add(keys(0, 1000), "batch-0")
    assert len(index.segments()) == 3 and index.unseen(keys(0, 1000)).count() == 0


# J4, Z2
def vectors(spark, n, seed, first=0):
    draw = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, 16))
    out = []
    for i in range(first, first + n):
        c = int(draw.integers(12))
        v = centres[c] + 0.15 * draw.normal(size=16)
        out.append((i, "odd" if c % 2 else "even", [float(x) for x in v]))
    return out


def test_knn_index_equals_a_full_run(spark, tmp_path):
    schema = "id long, grp string, vec array<double>"
    every = vectors(spark, 420, 1)
    every[50] = (50, *every[10][1:])  # equal vectors
    every[300] = (300, *every[10][1:])
    odd = [(900, None, [1.0] * 16), (901, "even", None), (902, "even", [0.0] * 16), (903, "alone", [1.0] * 16)]
    index, fed = KnnIndex(spark, f"{tmp_path}/index", k=4, pivots=8, tile=60), []
    want = lambda: sorted((r["id"], r["neighbor_id"], r["grp"], r["cosine"], r["rank"]) for r in knn_join(
        spark.createDataFrame(fed, schema), "id", "grp", "vec", 4).collect())
    for part in (every[:200] + odd[:2], every[200:330] + odd[2:3], every[330:] + odd[3:]):
        fed += part
        added = index.add(spark.createDataFrame(part, schema), "id", "grp", "vec")
        full = want()
        got = sorted((r["id"], r["neighbor_id"], r["grp"], r["cosine"], r["rank"]) for r in index.neighbours().collect())
        assert [g[:3] + g[4:] for g in got] == [f[:3] + f[4:] for f in full]
        assert np.allclose([g[3] for g in got], [f[3] for f in full], atol=2e-9)
        ids = {p[0] for p in part}
        assert sorted((r["id"], r["neighbor_id"], r["rank"]) for r in added.collect()) == [
            (g[0], g[1], g[4]) for g in got if g[0] in ids]
    # The same batch again: nothing new.
    version = index.table.version()
    assert index.add(spark.createDataFrame(every[330:], schema), "id", "grp", "vec") is None and index.table.version() == version


def test_knn_index_reads_what_a_batch_needs(spark, tmp_path):
    schema = "id long, grp string, vec array<double>"
    index = KnnIndex(spark, f"{tmp_path}/index", k=3, pivots=12)
    index.add(spark.createDataFrame(vectors(spark, 600, 2), schema), "id", "grp", "vec")
    files = index.table.files()
    one = vectors(spark, 1, 3, first=5000)
    index.add(spark.createDataFrame(one, schema), "id", "grp", "vec")
    small = index.read_rows
    index.add(spark.createDataFrame(vectors(spark, 120, 4, first=6000), schema), "id", "grp", "vec")
    assert 0 < small < 0.4 * 600 and index.read_rows > small
    assert sum(files[c] == f for c, f in index.table.files().items() if c in files) >= 0
    assert index.table.read().count() == 721


# V10, K7
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_prefix_join_equals_all_pairs(spark, threshold):
    draw = random.Random(7)
    letters = [f"e{i}" for i in range(40)]
    common = lambda: [letters[min(int(draw.expovariate(0.12)), 39)] for _ in range(draw.randint(0, 14))]
    left = [(i, common()) for i in range(60)] + [(900, None), (901, []), (902, ["unknown"]), (903, [None, "e1", "e1"])]
    right = [(i, common()) for i in range(150)] + [(900, None), (901, []), (903, ["e1"])]
    frame = lambda x: spark.createDataFrame(x, "id long, elements array<string>")
    index = set_index(frame(right), threshold)
    want = {}
    for i, a in left:
        for j, b in right:
            x, y = set(a or []) - {None}, set(b or []) - {None}
            if x and y and len(x & y) / len(x | y) >= threshold:
                want[i, j] = round(len(x & y) / len(x | y), 9)
    got = {(r["request_id"], r["id"]): round(r["sim"], 9) for r in similar_sets(frame(left), index).collect()}
    assert got == want and (903, 903) in want
    met = {tuple(r) for r in candidates(frame(left), index).collect()}
    shared = sum(bool(set(a or []) & set(b or []) - {None}) for _, a in left for _, b in right)
    assert set(want) <= met and len(met) < (0.75 if threshold < 0.5 else 0.4) * shared


def test_prefix_join_on_texts(spark, sf_dir):
    from partweave.bindings import registry

    queries, oracles = registry()
    plain = rows(queries["k7_trigram_search"](spark, sf_dir))
    assert rows(queries["k7_prefix_search"](spark, sf_dir)) == plain and oracles["k7_prefix_search"] == oracles["k7_trigram_search"]


# G8
def test_groups_equal_recomputation_over_five_batches(spark, tmp_path):
    draw, fed = random.Random(4), []
    groups = GroupTable(spark, f"{tmp_path}/groups", buckets=8)
    for turn in range(5):
        batch = [(f"r{draw.randrange(300):03d}", f"r{draw.randrange(300):03d}") for _ in range(45)] + [("r000", None), (None, "r001")]
        if turn == 3:
            batch = fed[:20] + [("solo", "solo")]
        fed += batch
        groups.add(spark.createDataFrame(batch, "a string, b string"))
        links = spark.createDataFrame(fed, "a string, b string").filter("a is not null and b is not null")
        nodes = links.select(F.col("a").alias("node")).union(links.select("b"))
        assert rows(groups.read()) == rows(connected_components(links, vertices=nodes))
        held = groups.members.read().select("node", "component")
        assert rows(held) == rows(groups.read())


def test_a_batch_of_groups_moves_only_what_merges(spark, tmp_path):
    groups = GroupTable(spark, f"{tmp_path}/groups", buckets=32)
    pairs = lambda n, at: [(f"{at}{i:04d}a", f"{at}{i:04d}b") for i in range(n)]
    groups.add(spark.createDataFrame(pairs(400, "x"), "a string, b string"))
    before = groups.labels.files()
    groups.add(spark.createDataFrame([("x0001b", "x0002a")], "a string, b string"))
    after = groups.labels.files()
    assert groups.moved == 2 and sum(before[b] != after[b] for b in before) <= 4
