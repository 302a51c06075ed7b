"""The stages of the pipeline read each text as often as they have to, and give what their plain rules give."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from partweave.llm import minhash, pii, quality, suffix_dedup


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lines_are_cut_once(small):
    """The lines of the texts are exploded for the written counts; the verdicts only read those."""
    assert "Generate" not in plan_of(quality.quality_verdicts(small))


def test_filter_writes_the_columns_it_needs(small, monkeypatch):
    written = []
    real = quality.materialise
    monkeypatch.setattr(quality, "materialise", lambda df: written.append(df.columns) or real(df))
    quality.quality_filter(small)
    assert written[-1] == ["doc_id", "kept", "removed_lines"]


@pytest.mark.parametrize("change", [quality.quality_filter, minhash.one_per_group, suffix_dedup.without_repeats, pii.mask_pii])
def test_texts_are_not_sorted(small, change):
    """Documents meet the few rows that change or keep them by a hash of those."""
    top = plan_of(change(small)).split("ShuffledHashJoin", 1)
    assert len(top) == 2 and "SortMergeJoin" not in top[0] and not re.search(r"Sort \[(row|text)", "".join(top))


def plain_verdict(words):
    """(repeated words, failed) by definition."""
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_repeated_words_around_the_limits(spark):
    """The bound that spares most documents never changes a verdict."""
    draw, texts = random.Random(5), ["", "a", "a a", "a a a", "a a a a", "a b c a b c"]
    for repeated in range(0, 60, 2):
        phrase = [f"p{i}" for i in range(draw.choice([3, 4, 9]))]
        words = [f"w{draw.randrange(10_000)}" for _ in range(draw.choice([40, 60, 90]))]
        for _ in range(repeated // 2):
            at = draw.randrange(len(words))
            words[at:at] = phrase
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_repeat_words"], r["base_failed"]) for r in quality.base_rules(frame).collect()}
    want = {i: plain_verdict(t.split()) for i, t in enumerate(texts)}
    assert found == want and 5 < sum(n * 2 > 50 and not f for n, f in want.values())


def test_lines_are_normalised_as_before(spark):
    draw = random.Random(7)
    lines = ["".join(draw.choice("aBÇ019 \t\x0b\r  .") for _ in range(draw.randrange(1, 25))) for _ in range(400)]
    lines = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    squeezed = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    found = frame.select("id", quality.normalised_line(F.col("line")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in found} == {i: re.sub("[0-9]", "0", squeezed(x).lower()) for i, x in enumerate(lines)}
    counts = quality.line_counts(frame.selectExpr("id as doc_id", "line as text", "'h' as source")).collect()
    assert {r["doc_id"]: r["words"] for r in counts} == {i: len(squeezed(x).split(" ")) for i, x in enumerate(lines)}


def test_runs_are_made_once_and_let_go(spark, small, monkeypatch):
    made, real = [], suffix_dedup.text_runs
    monkeypatch.setattr(suffix_dedup, "text_runs", lambda *a: made.append(real(*a)) or made[-1])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    suffix_dedup.without_repeats(small).count()
    assert len(made) == 1 and not made[0].is_cached and spark.sparkContext._jsc.getPersistentRDDs().size() == before
