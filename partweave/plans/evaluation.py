"""Match quality against a truth key per record (Q16-Q18)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..masters import POSITIVE
from ..operators.components import connected_components


def _pairs(n):
    return (n * (n - 1) / 2).cast("bigint")


def _truth(truth: DataFrame) -> DataFrame:
    usable = F.col("truth_key").isNotNull() & ~F.col("truth_key").rlike("^(INSUFF|UNC)")
    return truth.filter(usable).select("record_id", "truth_key")


def judged_pairs(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs whose two records both have a usable truth key, with ``same``."""
    t = _truth(truth)
    a = t.withColumnsRenamed({"record_id": "a_record_id", "truth_key": "_ta"})
    b = t.withColumnsRenamed({"record_id": "b_record_id", "truth_key": "_tb"})
    return recs.select("a_record_id", "b_record_id", "match_type", "vetoed").join(a, "a_record_id").join(
        b, "b_record_id").withColumn("same", F.col("_ta") == F.col("_tb"))


def evaluate(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision, pair recall, cluster recall, functional and veto confusion."""
    t = _truth(truth)
    totals = t.groupBy("truth_key").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated_records"),
        F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("truth_pairs"))
    judged = judged_pairs(recs, truth)
    positive = F.col("match_type").isin(POSITIVE)
    functional = F.col("match_type") == "FUNCTIONALLY_EQUIVALENT"
    counts = judged.agg(
        F.count_if(positive & F.col("same")).alias("true_positives"),
        F.count_if(positive & ~F.col("same")).alias("false_positives"),
        F.countDistinct(F.when(positive & F.col("same"), F.struct(
            F.least("a_record_id", "b_record_id"), F.greatest("a_record_id", "b_record_id")))).alias("found_pairs"),
        F.count_if(functional & F.col("same")).alias("functional_same"),
        F.count_if(functional & ~F.col("same")).alias("functional_different"),
        F.count_if(F.col("vetoed") & ~F.col("same")).alias("veto_correct"),
        F.count_if(F.col("vetoed") & F.col("same")).alias("veto_wrong"))
    cluster = cluster_pairs(judged, t)
    one = reduce(lambda a, b: a.crossJoin(b), [totals, counts, cluster])      # three one-row frames
    share = lambda x, y: F.try_divide(F.col(x), y)
    return one.withColumns({
        "precision": share("true_positives", F.col("true_positives") + F.col("false_positives")),
        "pair_recall": share("found_pairs", F.col("truth_pairs")),
        "cluster_recall": share("cluster_pairs", F.col("truth_pairs")),
        "veto_precision": share("veto_correct", F.col("veto_correct") + F.col("veto_wrong"))})


def cluster_pairs(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """Q17 - truth pairs connected through positive pairs of the same truth, counted by C(n, 2) per component."""
    edges = judged.filter(F.col("match_type").isin(POSITIVE) & F.col("same")).select(
        F.col("a_record_id").alias("a"), F.col("b_record_id").alias("b"))
    comp = connected_components(edges).withColumnRenamed("node", "record_id")
    return comp.join(truth, "record_id").groupBy("truth_key", "component").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("cluster_pairs"))
