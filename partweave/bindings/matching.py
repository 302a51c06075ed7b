"""Candidates, verdict rules and selection (J*, M*, R*) over the derived pairs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..masters import DEFAULT_CONFIG, QUEUE_OF_ROUTING
from ..operators import candidates as C
from ..operators import scoring as M
from ..operators import selection as R
from .base import Domain, oracle, query

# Facts of a pair that the run would derive from its comparisons.
FACTS = ("SELECT r.*, pk % 7 = 0 AS insufficient, CASE WHEN pk % 5 = 0 THEN 'MPN_EXACT' WHEN pk % 5 = 1 THEN 'FINGERPRINT' END "
         "AS deterministic, pk % 4 = 0 AS text_identical, pk % 9 = 0 AS identity_differs, "
         "CASE WHEN pk % 3 = 0 THEN 1 ELSE 0 END AS miss_a, CASE WHEN pk % 4 = 1 THEN 1 ELSE 0 END AS miss_b FROM {recs} r")
PAIRS = "facts AS (" + FACTS.format(recs="recs") + ")"
K = DEFAULT_CONFIG


def _facts(spark, d):
    missing = lambda c: F.when(F.col(c) > 0, F.array(F.lit("key"))).otherwise(F.array().cast("array<string>"))
    vetoes = F.when(F.col("vetoed"), F.array(F.struct(
        F.when(F.col("pk") % 2 == 0, "SIZE").otherwise("PRESSURE").alias("kind"),
        F.concat(F.lit("RULE_"), (F.col("pk") % 3).cast("string")).alias("rule")))).otherwise(
        F.array().cast("array<struct<kind:string,rule:string>>"))
    return spark.sql(FACTS, recs=Domain(spark, d).recs).withColumns({
        "a_missing_required": missing("miss_a"), "b_missing_required": missing("miss_b"), "vetoes": vetoes})


@query("j1_block_pairs", oracle("""SELECT a.block, a.id AS a_id, b.id AS b_id, a.n AS a_copies, b.n AS b_copies FROM blk a
  JOIN blk b ON a.block = b.block AND a.id < b.id""", """blk AS (SELECT concat(org, '|', desig, '|', seal, '|', clear) AS block,
  min(record_id) AS id, count(*) AS n FROM raw WHERE family = 'BEARING' GROUP BY 1, description)"""))
def j1(spark, d):
    """Every pair of different descriptions inside a block, copies counted."""
    keyed = Domain(spark, d).raw.filter("family = 'BEARING'").withColumn("block", F.concat_ws("|", "org", "desig", "seal", "clear"))
    return C.blocking_pairs(keyed, "record_id", "block", ["description"])


@query("m8_match_type", oracle(f"""SELECT pair_key, CASE WHEN vetoed THEN 'RELATED_BUT_NOT_EQUIVALENT' WHEN insufficient THEN
  'INSUFFICIENT_DATA' WHEN identity_differs THEN CASE WHEN raw_score >= {K.functional} THEN 'FUNCTIONALLY_EQUIVALENT' WHEN
  raw_score >= {K.related} THEN 'RELATED_BUT_NOT_EQUIVALENT' ELSE 'NOT_MATCHED' END
  WHEN raw_score >= {K.duplicate} AND (deterministic = 'MPN_EXACT' OR deterministic IS NOT NULL AND text_identical) THEN 'IDENTICAL'
  WHEN raw_score >= {K.duplicate} AND deterministic IS NOT NULL THEN 'DUPLICATE'
  WHEN raw_score >= {K.near_duplicate} OR raw_score >= {K.functional} AND deterministic IS NOT NULL THEN 'NEAR_DUPLICATE'
  WHEN raw_score >= {K.functional} THEN 'FUNCTIONALLY_EQUIVALENT' WHEN raw_score >= {K.related} THEN
  'RELATED_BUT_NOT_EQUIVALENT' ELSE 'NOT_MATCHED' END AS verdict FROM facts""", PAIRS))
def m8(spark, d):
    c = F.col
    return _facts(spark, d).select("pair_key", M.classify_match(
        c("raw_score"), c("vetoed"), c("insufficient"), c("deterministic"), c("text_identical"), c("identity_differs")).alias("verdict"))


@query("m9_capped_score", oracle("SELECT pair_key, final_score AS capped FROM recs"))
def m9(spark, d):
    return Domain(spark, d).recs.select("pair_key", M.capped_score(F.col("raw_score"), F.col("vetoed")).alias("capped"))


@query("m10_routing", oracle("SELECT pair_key, routing AS route FROM recs"))
def m10(spark, d):
    return Domain(spark, d).recs.select("pair_key", M.route_match(F.col("match_type"), F.col("final_score")).alias("route"))


@query("m14_confidence_band", oracle("""SELECT pair_key, CASE WHEN vetoed THEN 'veto' WHEN final_score >= 0.95 THEN 'high'
  WHEN final_score >= 0.75 THEN 'amber' ELSE 'neutral' END AS band FROM recs"""))
def m14(spark, d):
    return Domain(spark, d).recs.select("pair_key", M.confidence_band(F.col("vetoed"), F.col("final_score")).alias("band"))


@query("m15_reason_band", oracle("""SELECT pair_key, CASE pk % 5 WHEN 0 THEN 'veto' WHEN 1 THEN 'high' WHEN 2 THEN 'amber' WHEN 3 THEN
  'amber' ELSE 'neutral' END AS band FROM recs"""))
def m15(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("VETO_SIZE", "MPN_EXACT", "PRICE_CONFLICT", "TEXT_PARTIAL", "NO_PRICE")]),
                        (F.col("pk") % 5 + 1).cast("int"))
    return Domain(spark, d).recs.select("pair_key", M.reason_band(code).alias("band"))


@query("r1_stored_pairs", oracle("""SELECT pair_key FROM recs WHERE match_type IN ('IDENTICAL', 'DUPLICATE', 'NEAR_DUPLICATE',
  'FUNCTIONALLY_EQUIVALENT') OR match_type = 'RELATED_BUT_NOT_EQUIVALENT' AND CASE WHEN vetoed THEN raw_score >= 0.72 AND
  pk % 2 = 1 ELSE raw_score >= 0.62 END"""))
def r1(spark, d):
    return _facts(spark, d).filter(R.store_filter(F.col("match_type"), F.col("raw_score"), F.col("vetoes"))).select("pair_key")


@query("r2_insufficient_top3", oracle("""SELECT DISTINCT pair_key FROM (SELECT pair_key, row_number() OVER (PARTITION BY id ORDER BY
  raw_score DESC, pair_key) AS rn FROM (SELECT pair_key, raw_score, a_record_id AS id FROM facts WHERE miss_a > 0 AND match_type =
  'INSUFFICIENT_DATA' UNION ALL SELECT pair_key, raw_score, b_record_id FROM facts WHERE miss_b > 0 AND match_type =
  'INSUFFICIENT_DATA')) WHERE rn <= 3""", PAIRS))
def r2(spark, d):
    return R.insufficient_top3(_facts(spark, d))


@query("r3_nearest_evidence", oracle("""SELECT DISTINCT pair_key FROM (SELECT pair_key, row_number() OVER (PARTITION BY id ORDER BY
  raw_score DESC, pair_key) AS rn FROM side WHERE id NOT IN (SELECT id FROM side WHERE routing <> 'NONE')) WHERE rn = 1""",
       """side AS (SELECT pair_key, raw_score, routing, a_record_id AS id FROM recs UNION ALL SELECT pair_key, raw_score, routing,
  b_record_id FROM recs)"""))
def r3(spark, d):
    pairs = Domain(spark, d).recs
    ids = R.covered_ids(pairs).join(R.covered_ids(pairs.filter("routing <> 'NONE'")), "record_id", "left_anti")
    return R.nearest_evidence(pairs, ids)


CODED = """coded AS (SELECT r.*, ma.cnmc AS a_cnmc, mb.cnmc AS b_cnmc FROM recs r
  LEFT JOIN mappings ma ON ma.record_id = a_record_id AND ma.status = 'ACTIVE'
  LEFT JOIN mappings mb ON mb.record_id = b_record_id AND mb.status = 'ACTIVE')"""


def _coded(spark, d):
    of = Domain(spark, d)
    code = lambda s: of.mappings.filter("status = 'ACTIVE'").select(F.col("record_id").alias(f"{s}_record_id"), F.col("cnmc").alias(f"{s}_cnmc"))
    return of.recs.join(code("a"), "a_record_id", "left").join(code("b"), "b_record_id", "left")


@query("r4_collapsed_pairs", oracle("""SELECT pair_key FROM (SELECT pair_key, row_number() OVER (PARTITION BY CASE WHEN a_cnmc IS NULL
  THEN a_record_id ELSE b_record_id END, coalesce(a_cnmc, b_cnmc) ORDER BY final_score DESC, pair_key) AS rn FROM coded
  WHERE NOT vetoed AND (a_cnmc IS NULL) <> (b_cnmc IS NULL)) WHERE rn > 1""", CODED))
def r4(spark, d):
    return R.collapse_into_groups(_coded(spark, d))


@query("r5_open_pairs", oracle("""SELECT pair_key FROM coded WHERE NOT coalesce(a_cnmc = b_cnmc, false) AND
  status IN ('PENDING', 'NEEDS_INFO')""", CODED))
def r5(spark, d):
    pairs = _coded(spark, d)
    return R.open_for_update(pairs, pairs.select("pair_key", "status")).select("pair_key")


QUEUES = "CASE routing " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in QUEUE_OF_ROUTING.items()) + " END"


@query("r8_tasks", oracle(f"""SELECT pair_key, {QUEUES} AS queue, CASE match_type WHEN 'FUNCTIONALLY_EQUIVALENT' THEN 1 WHEN
  'NEAR_DUPLICATE' THEN 2 WHEN 'INSUFFICIENT_DATA' THEN 4 ELSE 3 END AS priority, 'OPEN' AS status FROM recs
  WHERE {QUEUES} IS NOT NULL"""))
def r8(spark, d):
    return R.assign_tasks(Domain(spark, d).recs)


@query("r9_superseded", oracle("""SELECT pair_key, CASE WHEN status = 'PENDING' AND pk % 2 = 0 THEN 'SUPERSEDED' ELSE status END
  AS status FROM recs"""))
def r9(spark, d):
    pairs = Domain(spark, d).recs.withColumn("decision_note", F.lit(None).cast("string"))
    return R.supersede(pairs, pairs.filter("pk % 2 = 0")).select("pair_key", "status")


@query("r10_run_statistics", oracle("""SELECT 'match_type' AS kind, match_type AS key, count(*) AS n FROM recs GROUP BY match_type
  UNION ALL SELECT 'veto', concat('RULE_', pk % 3), count(*) FROM recs WHERE vetoed GROUP BY pk % 3"""))
def r10(spark, d):
    return R.run_statistics(_facts(spark, d))
