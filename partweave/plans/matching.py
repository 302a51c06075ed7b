"""The matching run: candidates -> evaluation -> selection, as one sequence of DataFrames."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..masters import DEFAULT_CONFIG, SCHEMAS, SUBSTITUTION_RULES, EngineConfig
from ..operators import candidates as C
from ..operators import selection as R
from ..operators.embed import with_embedding
from ..operators.process import matchable
from ..operators.scoring import score_pairs
from ..session import cut_lineage

OUTPUT = ["pair_key", "a_record_id", "b_record_id", "a_org", "b_org", "a_cnmc", "b_cnmc", "a_copies", "b_copies",
          "category", "match_type", "raw_score", "final_score", "components", "weights", "deterministic", "vetoed",
          "vetoes", "substitutions", "comparisons", "a_missing_required", "b_missing_required", "reason_codes",
          "explanation", "routing", "a_attributes", "b_attributes"]


@dataclass
class MatchRun:
    recommendations: DataFrame   # kept pairs with proposal
    tasks: DataFrame             # review queue entries
    dropped: DataFrame           # pair keys collapsed into a stronger pair
    statistics: DataFrame        # (kind, key, n)


def prepare(records: DataFrame, mappings: DataFrame | None = None, batch_id: str | None = None) -> DataFrame:
    """Matchable records with their active canonical code and whether they are targets of this run."""
    out = matchable(records)
    if "embedding" not in out.columns:
        out = with_embedding(out)
    if mappings is None:
        out = out.withColumn("cnmc", F.lit(None).cast("string"))
    else:
        active = mappings.filter(F.col("status") == "ACTIVE").select("record_id", "cnmc")
        out = out.drop("cnmc").join(active, "record_id", "left")
    target = F.lit(True) if batch_id is None else F.coalesce(F.col("batch_id") == batch_id, F.lit(False))
    return out.withColumns({"is_target": target, "copies": F.lit(1).cast("bigint")})


def _bound(pp: DataFrame, partners: int) -> DataFrame:
    """Per profile: a score that at least ``partners`` of its candidate pairs are certain to reach.  Only profiles with
    enough variants for one pair of profiles to guarantee it on its own are used, which keeps this one max()."""
    room = F.when(F.col("a_profile_key") == F.col("b_profile_key"), F.col("b_n_variants") - 1).otherwise(
        F.col("b_n_variants"))
    return pp.groupBy(F.col("a_profile_key").alias("profile_key")).agg(
        F.max(F.when(room >= partners, F.col("score_floor"))).alias("bound"))


def _reach(pp: DataFrame, bounds: DataFrame, side: str):
    b = bounds.withColumnsRenamed({"profile_key": f"{side}_profile_key", "bound": f"_{side}_bound"})
    return pp.join(b, f"{side}_profile_key", "left")


def run_matching(records: DataFrame, config: EngineConfig = DEFAULT_CONFIG, schemas=SCHEMAS, rules=SUBSTITUTION_RULES,
                 mappings: DataFrame | None = None, canonical: DataFrame | None = None,
                 existing: DataFrame | None = None, batch_id: str | None = None) -> MatchRun:
    """``records`` is the output of ``process_records``.  Intermediate results that feed several branches are written
    to the checkpoint folder once, so a lost executor costs one stage and nothing is recomputed per branch."""
    # The boundary before the first filter keeps it from being pushed into the record program.
    prepared = cut_lineage(prepare(cut_lineage(records), mappings, batch_id).select(*C.SIDE_COLUMNS))
    vars_ = cut_lineage(C.variants(prepared))

    # --- candidates: attribute verdict per profile pair, then only the pairs that can matter
    pp = cut_lineage(C.profile_pairs(vars_, config, schemas, rules))
    likely = C.expand_profiles(pp.filter(C.storable(config)), vars_, vars_)
    lean = pp.filter((F.size("vetoes") == 0) & (F.size("a_missing_required") + F.size("b_missing_required") > 0))
    three = _bound(lean, 3)
    needed = lambda s: (F.size(f"{s}_missing_required") > 0) & (
        F.col(f"_{s}_bound").isNull() | (F.col("score_ceiling") >= F.col(f"_{s}_bound")))
    lean = _reach(_reach(lean, three, "a"), three, "b").filter(needed("a") | needed("b"))
    under = C.expand_profiles(lean, vars_, vars_)
    near = C.knn_pairs(vars_, config, schemas, rules).filter(~F.col("same_block")).drop("same_block")
    twins = _copy_pairs(prepared, vars_, config, schemas, rules)
    columns = [c for c in likely.columns]
    pool = likely.unionByName(under.select(columns)).unionByName(near.select(columns))
    scored = cut_lineage(score_pairs(pool, config, schemas, rules, structured=True).select(*OUTPUT)
                         .unionByName(twins))

    # --- selection
    kept = scored.filter(R.store_filter(F.col("match_type"), F.col("raw_score"), F.col("vetoes")))
    weak = scored.join(R.insufficient_top3(scored), "pair_key", "left_semi")
    stored = kept.unionByName(weak)
    uncovered = cut_lineage(vars_.filter("is_target").join(R.covered_ids(stored), "record_id", "left_anti"))
    evidence_pool = _block_evidence(pp, uncovered, vars_, config, schemas, rules).unionByName(
        scored.join(uncovered.select(F.col("record_id").alias("a_record_id")), "a_record_id", "left_semi").select(OUTPUT)
    ).unionByName(
        scored.join(uncovered.select(F.col("record_id").alias("b_record_id")), "b_record_id", "left_semi").select(OUTPUT)
    ).dropDuplicates(["pair_key"])
    evidence = evidence_pool.join(R.nearest_evidence(evidence_pool, uncovered), "pair_key", "left_semi")
    stored = cut_lineage(stored.unionByName(evidence.select(OUTPUT)).dropDuplicates(["pair_key"]))

    dropped = R.collapse_into_groups(stored)
    counted = stored.join(dropped, "pair_key", "left_anti")  # statistics cover what the guards then skip
    final = R.open_for_update(counted, existing)
    final = R.with_proposal(final, canonical).drop("a_attributes", "b_attributes")
    return MatchRun(final, R.assign_tasks(final), dropped, R.run_statistics(counted))


def _copy_pairs(prepared: DataFrame, vars_: DataFrame, config, schemas, rules) -> DataFrame:
    """Pairs (representative, copy): the verdict is computed once per variant and attached to each of its copies."""
    twin = vars_.filter("copies > 1")
    selfs = C.side(twin, "a").join(
        C.side(twin, "b").withColumnRenamed("b_record_id", "_same"), F.col("a_record_id") == F.col("_same")).withColumn(
        "b_record_id", F.col("_same")).drop("_same").withColumn("pair_key", F.lit(""))
    verdict = score_pairs(selfs, config, schemas, rules).select(*OUTPUT).drop("b_record_id", "pair_key")
    links = C.copy_links(prepared).withColumnsRenamed({"a_id": "a_record_id", "b_id": "b_record_id"})
    return links.join(verdict, "a_record_id").withColumn(
        "pair_key", C.pair_key(F.col("a_record_id"), F.col("b_record_id"))).select(*OUTPUT)


def _block_evidence(pp: DataFrame, uncovered: DataFrame, vars_: DataFrame, config, schemas, rules) -> DataFrame:
    """Block pairs that can be the best pair of an uncovered record: the ceiling reaches the profile's certain best."""
    one = _bound(pp, 1)
    can_win = lambda s: F.col(f"_{s}_bound").isNull() | (F.col("score_ceiling") >= F.col(f"_{s}_bound"))
    as_a = C.expand_profiles(_reach(pp, one, "a").filter(can_win("a")), uncovered, vars_)
    as_b = C.expand_profiles(_reach(pp, one, "b").filter(can_win("b")), vars_, uncovered)
    pool = as_a.unionByName(as_b).dropDuplicates(["pair_key"])
    return score_pairs(pool, config, schemas, rules, structured=True).select(*OUTPUT)
