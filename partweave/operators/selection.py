"""Which evaluated pairs are kept, queued or retired."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import lookup
from ..masters import POSITIVE, QUEUE_OF_ROUTING
from .describe import canonical_description, merge_attributes, template_code

OPEN = ["PENDING", "NEEDS_INFO"]


def store_filter(match_type: Column, raw: Column, vetoes: Column) -> Column:
    """R1 - positives always; related pairs only when informative."""
    related = match_type == "RELATED_BUT_NOT_EQUIVALENT"
    vetoed = F.size(vetoes) > 0
    return match_type.isin(*POSITIVE, "FUNCTIONALLY_EQUIVALENT") | (
        related & vetoed & (raw >= 0.72) & F.exists(vetoes, lambda v: v["kind"] != "SIZE")) | (
        related & ~vetoed & (raw >= 0.62))


def top_per_record(pairs: DataFrame, record_col: str, k: int, score: str = "raw_score") -> DataFrame:
    """Best k pairs per record; total order by score and pair key."""
    w = Window.partitionBy(record_col).orderBy(F.desc(score), F.asc("pair_key"))
    return pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def insufficient_top3(pairs: DataFrame, k: int = 3) -> DataFrame:
    """R2 - pair keys of the strongest candidates of every record that itself misses required attributes."""
    lean = pairs.filter(F.col("match_type") == "INSUFFICIENT_DATA").select(
        "pair_key", "raw_score", F.explode(F.array(
            F.struct(F.col("a_record_id").alias("id"), F.size("a_missing_required").alias("miss")),
            F.struct(F.col("b_record_id").alias("id"), F.size("b_missing_required").alias("miss")))).alias("s"))
    ranked = top_per_record(lean.filter("s.miss > 0").select("pair_key", "raw_score", F.col("s.id").alias("id")), "id", k)
    return ranked.select("pair_key").distinct()


def covered_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a_record_id", "b_record_id")).alias("record_id")).distinct()


def nearest_evidence(pairs: DataFrame, uncovered: DataFrame) -> DataFrame:
    """R3 - pair keys of the best pair (any type) of every record that no kept pair covers; unique by pair."""
    sides = pairs.select("pair_key", "raw_score", F.explode(F.array("a_record_id", "b_record_id")).alias("record_id"))
    wanted = sides.join(uncovered.select("record_id"), "record_id", "left_semi")
    return top_per_record(wanted, "record_id", 1).select("pair_key").distinct()


def collapse_into_groups(pairs: DataFrame) -> DataFrame:
    """R4 - pair keys to drop: of all unvetoed pairs that lead one unmapped record into the same canonical group, all
    but the strongest.  Needs a_cnmc / b_cnmc."""
    one_sided = pairs.filter(~F.col("vetoed") & (F.col("a_cnmc").isNull() != F.col("b_cnmc").isNull())).select(
        "pair_key", "final_score",
        F.when(F.col("a_cnmc").isNull(), F.col("a_record_id")).otherwise(F.col("b_record_id")).alias("record_id"),
        F.coalesce("a_cnmc", "b_cnmc").alias("cnmc"))
    w = Window.partitionBy("record_id", "cnmc").orderBy(F.desc("final_score"), F.asc("pair_key"))
    return one_sided.withColumn("_rn", F.row_number().over(w)).filter("_rn > 1").select("pair_key")


def open_for_update(pairs: DataFrame, existing: DataFrame | None) -> DataFrame:
    """R5/R6 - never touch decided pairs, skip pairs whose two records already share a canonical."""
    out = pairs.filter(~F.coalesce(F.col("a_cnmc") == F.col("b_cnmc"), F.lit(False)))
    if existing is not None:
        decided = existing.filter(~F.col("status").isin(OPEN)).select("pair_key")
        out = out.join(decided, "pair_key", "left_anti")
    return out


def with_proposal(pairs: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """R7 - code of the mapped side if any, else the template of the merged attributes (NULL when incomplete)."""
    merged = merge_attributes(F.col("a_attributes"), F.col("b_attributes"))
    anchor = F.coalesce("a_cnmc", "b_cnmc")
    missing = (F.size("a_missing_required") + F.size("b_missing_required")) > 0
    out = (
        pairs.withColumn("_merged", merged)
        .withColumn("proposed_cnmc", F.coalesce(anchor, F.when(~missing, template_code(
            F.col("category"), F.col("_merged")))))
        .withColumn("proposed_description", canonical_description(F.col("category"), F.col("_merged")))
        .drop("_merged")
    )
    if canonical is None:
        return out
    names = canonical.select(F.col("cnmc").alias("_anchor"), F.col("description").alias("_anchor_desc"))
    return out.withColumn("_anchor", anchor).join(names, "_anchor", "left").withColumn(
        "proposed_description", F.coalesce("_anchor_desc", "proposed_description")).drop("_anchor", "_anchor_desc")


def queue_of(routing: Column) -> Column:
    return lookup(QUEUE_OF_ROUTING, routing)


def priority_of(match_type: Column) -> Column:
    return (F.when(match_type == "FUNCTIONALLY_EQUIVALENT", 1).when(match_type == "NEAR_DUPLICATE", 2)
            .when(match_type == "INSUFFICIENT_DATA", 4).otherwise(3))


def assign_tasks(pairs: DataFrame) -> DataFrame:
    """R8 - review tasks of the routed pairs."""
    return pairs.select("pair_key", queue_of(F.col("routing")).alias("queue"),
                        priority_of(F.col("match_type")).alias("priority"), F.lit("OPEN").alias("status")).filter(
        F.col("queue").isNotNull())


def supersede(existing: DataFrame, dropped: DataFrame) -> DataFrame:
    """R9 - stale open pairs dominated by a stronger pair into the same code."""
    gone = dropped.select("pair_key").distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("status") == "PENDING")
    return existing.join(gone, "pair_key", "left").withColumns({
        "decision_note": F.when(hit, F.lit("Collapsed: a stronger pair into the same national code is queued"))
        .otherwise(F.col("decision_note")),
        "status": F.when(hit, F.lit("SUPERSEDED")).otherwise(F.col("status")),
    }).drop("_gone")


def run_statistics(pairs: DataFrame) -> DataFrame:
    """R10 - (kind, key, n): pairs per match type and per veto rule, in one pass over the pairs."""
    facts = F.explode(F.concat(
        F.array(F.struct(F.lit("match_type").alias("kind"), F.col("match_type").alias("key"))),
        F.transform("vetoes", lambda v: F.struct(F.lit("veto").alias("kind"), v["rule"].alias("key")))))
    return pairs.select(facts.alias("f")).groupBy("f.kind", "f.key").agg(F.count("*").alias("n"))
