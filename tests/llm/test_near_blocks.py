"""Groups of near copies whose members are not all linked with the centre of their bucket."""
import random

import pytest
from pyspark.sql import functions as F

from partweave.llm import minhash

from .test_documents import plain_components


def drifting(n, seed, words=60):
    """A text and copies that drift away from it: neighbours in the row are near, the ends are not."""
    draw = random.Random(seed)
    text = [f"w{draw.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        if draw.random() < 0.6:
            text = list(text)
            text[draw.randrange(words)] = f"w{draw.randrange(10_000)}"
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_drifting_copies(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = dict(enumerate(t for seed in range(3) for t in drifting(70, seed)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = plain_components(texts, 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, k=2, percent=80).collect()}
    assert got == want and 3 <= len({c for _, c in want.values()}) < 60


def test_blocks_deal_signatures_before_texts(spark, monkeypatch):
    """Residents are dealt once and members that are away once a block, without texts; texts only follow partners."""
    dealt = {}

    def spy(name, real):
        def call(rows, *rest):
            dealt[name] = (rows.columns, rows.count(), rows.filter("resident").select("centre", "doc_id").distinct().count(),
                           rows.filter("not resident").count())
            return real(rows, *rest)
        return call

    for name in ("block_guests", "block_links"):
        monkeypatch.setattr(minhash, name, spy(name, getattr(minhash, name)))
    monkeypatch.setattr(minhash, "BLOCK", 64)
    draw = random.Random(5)
    base, rows = [f"w{i}" for i in range(80)], []
    for i in range(600):
        text = list(base)
        for _ in range(0 if i == 0 else draw.choice([1, 2, 2, 3, 9])):
            text[draw.randrange(80)] = f"x{i}_{draw.randrange(1000)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, k=2).collect()}
    assert got == plain_components(dict(rows), 2, 80)
    columns, count, members, visits = dealt["block_guests"]
    assert "packed" not in columns and count == members + visits
    assert "packed" in dealt["block_links"][0] and dealt["block_links"][3] <= visits
