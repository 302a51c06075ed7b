"""Dashboard, views and relational operators (Q*, K*, W*, X*, P*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import contains_text, half_up
from ..plans import dashboard as D
from ..plans import evaluation as E
from ..plans import views as V
from .base import Domain, oracle, query, table

R2 = lambda c: f"floor(({c}) * 100 + 0.5) / 100"
R3 = lambda c: f"floor(({c}) * 1000 + 0.5) / 1000"
ACTIVE = "active AS (SELECT * FROM mappings WHERE status = 'ACTIVE')"
WAITING = "status IN ('OPEN', 'NEEDS_INFO')"
POS = "match_type IN ('IDENTICAL', 'DUPLICATE', 'NEAR_DUPLICATE')"
OPPS = """opp AS (SELECT m.cnmc, c.category, count(DISTINCT m.org) AS orgs, count(*) AS codes,
  array_to_string(list_sort(list(DISTINCT m.org)), ',') AS org_codes, sum(r.price * r.qty) AS spend, sum(r.qty) AS qty,
  min(r.price) AS min_price, max(r.price) AS max_price, count(r.price) AS price_points
  FROM active m JOIN canonical c ON c.cnmc = m.cnmc AND c.status = 'APPROVED' JOIN raw r ON r.record_id = m.record_id
  GROUP BY m.cnmc, c.category HAVING count(DISTINCT m.org) >= 3)"""
RATE = "CASE WHEN orgs >= 5 THEN 0.12 WHEN orgs = 4 THEN 0.1 ELSE 0.08 END"


@query("q8_opportunities", oracle(f"""SELECT cnmc, category, orgs, codes, org_codes, {R2('spend')} AS spend, qty,
  min_price, max_price, price_points FROM opp""", ACTIVE, OPPS))
def q8(spark, d):
    x = Domain(spark, d)
    o = D.opportunities(x.canonical, x.mappings, x.raw)
    return o.drop("est_saving", "price_spread").withColumn("spend", half_up(F.col("spend"), 2))


@query("q9_saving_and_spread", oracle(f"""SELECT cnmc, {R2(f'spend * {RATE}')} AS est_saving,
  {R3('(max_price - min_price) / min_price')} AS price_spread FROM opp""", ACTIVE, OPPS))
def q9(spark, d):
    x = Domain(spark, d)
    o = D.opportunities(x.canonical, x.mappings, x.raw)
    return o.select("cnmc", half_up(F.col("est_saving"), 2).alias("est_saving"),
                    half_up(F.col("price_spread")).alias("price_spread"))


@query("q9_totals", oracle("SELECT count(*) AS groups, floor(sum(spend) + 0.5) AS total_spend FROM opp", ACTIVE, OPPS))
def q9t(spark, d):
    x = Domain(spark, d)
    o = D.opportunity_totals(D.opportunities(x.canonical, x.mappings, x.raw))
    return o.select("groups", F.floor(F.col("total_spend") + 0.5).cast("double").alias("total_spend"))


@query("w4_top_opportunities", oracle(
    f"SELECT cnmc, {R2('spend')} AS spend FROM opp ORDER BY {R2('spend')} DESC, cnmc LIMIT 6", ACTIVE, OPPS))
def w4(spark, d):
    x = Domain(spark, d)
    o = D.opportunities(x.canonical, x.mappings, x.raw).select("cnmc", half_up(F.col("spend"), 2).alias("spend"))
    return o.orderBy(F.desc("spend"), "cnmc").limit(6)


def _events(spark, d):
    return table(spark, d, "events").withColumn("action", F.col("event_type"))


def _norm_sql(alias="norm"):
    """Oracle stand-in for normalised records: facts that follow from how the descriptions were written."""
    return f"""{alias} AS (SELECT record_id, pk, rg, org, family AS category, batch_id,
      CASE WHEN uom IS NULL THEN ['UOM_MISSING'] WHEN uom = 'BOX' THEN ['UOM_UNRECOGNISED']
           WHEN uom IN ('EA') THEN (CASE WHEN family = 'CABLE' THEN ['UOM_DIMENSION_MISMATCH'] ELSE [] END)
           WHEN uom IN ('M', 'KM') THEN []
           WHEN uom = 'MT' THEN ['UOM_AMBIGUOUS_MT', 'UOM_NONSTANDARD_ALIAS'] ELSE ['UOM_NONSTANDARD_ALIAS'] END AS uflags
      FROM raw)"""


def light_norm(x: Domain, *more: str):
    """Normalised columns without text processing, for the relational analytics: family and unit flags; and ``more`` of the rows."""
    from ..functions.uom import normalize_uom
    from ..operators.extract import expected_dimension

    return x.raw.withColumn("category", F.col("family")).withColumn("u", normalize_uom(
        F.col("uom"), expected_dimension(F.col("category")))).select(
        "record_id", "org", "batch_id", "category", F.col("u.flags").alias("flags"),
        half_up(F.col("pk") % 100 / 100.0, 2).alias("completeness"),
        F.when(F.col("lean") == 1, F.array(F.lit("pressure_class"))).otherwise(F.array().cast("array<string>")).alias(
            "missing_required"),
        F.sequence(F.lit(1), F.lit(1) + (F.col("pk") % 3).cast("int")).alias("expansions"), *more)


@query("q1_kpi_totals", oracle(f"""SELECT (SELECT count(*) FROM raw) AS records, (SELECT count(DISTINCT org) FROM raw) AS orgs,
  (SELECT count(*) FROM canonical WHERE status = 'APPROVED') AS canonical, (SELECT count(*) FROM active) AS mapped,
  (SELECT count(*) FROM recs WHERE {POS}) AS duplicates,
  (SELECT count(*) FROM recs WHERE match_type = 'FUNCTIONALLY_EQUIVALENT') AS functional,
  (SELECT count(*) FROM tasks WHERE {WAITING}) AS pending, (SELECT count(*) FROM raw WHERE lean = 1) AS insufficient,
  (SELECT count(*) FROM raw WHERE family = 'UNCLASSIFIED') AS unclassified,
  (SELECT count(*) FROM norm WHERE len(uflags) > 0) AS uom_issues, (SELECT count(*) FROM recs WHERE vetoed) AS vetoes,
  (SELECT sum(1 + pk % 3) FROM raw) AS abbreviations, (SELECT count(*) FROM recs WHERE status = 'APPROVED') AS approved,
  (SELECT count(*) FROM recs WHERE status = 'REJECTED') AS rejected, (SELECT count(*) FROM events) AS audit_events,
  (SELECT {R3("avg(floor(pk % 100 / 100.0 * 100 + 0.5) / 100)")} FROM raw WHERE family <> 'UNCLASSIFIED') AS completeness,
  {R3("1 - (SELECT count(*) FROM canonical WHERE status = 'APPROVED') / CAST((SELECT count(*) FROM active) AS DOUBLE)")}
  AS code_reduction""", ACTIVE, _norm_sql()))
def q1(spark, d):
    x = Domain(spark, d)
    k = D.kpi_totals(x.raw, light_norm(x), x.recs, x.tasks, x.mappings, x.canonical, _events(spark, d))
    return k.withColumn("code_reduction", half_up(F.col("code_reduction")))


@query("q2_category_breakdown", oracle(f"""SELECT n.category, n.records, n.mapped, coalesce(c.n, 0) AS canonical,
  coalesce(p.n, 0) AS pending, coalesce(u.n, 0) AS duplicates, n.records - n.mapped AS remaining,
  {R3('n.mapped / CAST(n.records AS DOUBLE)')} AS pct_mapped
  FROM (SELECT family AS category, count(*) AS records, count(m.record_id) AS mapped FROM raw r LEFT JOIN active m
        ON m.record_id = r.record_id GROUP BY family) n
  LEFT JOIN (SELECT category, count(*) AS n FROM canonical WHERE status = 'APPROVED' GROUP BY 1) c USING (category)
  LEFT JOIN (SELECT category, count(*) AS n FROM recs JOIN tasks t USING (pair_key) WHERE t.{WAITING} GROUP BY 1) p
       USING (category)
  LEFT JOIN (SELECT category, count(*) AS n FROM recs WHERE {POS} GROUP BY 1) u USING (category)""", ACTIVE))
def q2(spark, d):
    x = Domain(spark, d)
    return D.category_breakdown(light_norm(x), x.mappings, x.canonical, x.recs, x.tasks)


@query("q3_match_type_histogram", oracle("""SELECT match_type, count(*) AS n, list_position(['IDENTICAL', 'DUPLICATE',
  'NEAR_DUPLICATE', 'FUNCTIONALLY_EQUIVALENT', 'RELATED_BUT_NOT_EQUIVALENT', 'INSUFFICIENT_DATA', 'NOT_MATCHED'],
  match_type) AS ordinal FROM recs GROUP BY match_type"""))
def q3(spark, d):
    return D.match_type_histogram(Domain(spark, d).recs)


PENDING_ORG = f"""pend AS (SELECT o.org, count(DISTINCT x.pair_key) AS pending FROM recs x JOIN tasks t
  ON t.pair_key = x.pair_key AND t.{WAITING} JOIN raw o ON o.record_id IN (x.a_record_id, x.b_record_id) GROUP BY o.org)"""


@query("k8_pending_per_org", oracle("SELECT org, pending FROM pend", PENDING_ORG))
def k8(spark, d):
    x = Domain(spark, d)
    return D.pending_per_org(x.raw, x.recs, x.tasks)


@query("q4_org_scorecard", oracle(f"""SELECT g.r_name AS org, coalesce(s.records, 0) AS records,
  coalesce(s.mapped, 0) AS mapped, coalesce(p.pending, 0) AS pending, coalesce(s.completeness, 0) AS completeness,
  coalesce(s.uom_issues, 0) AS uom_issues FROM region g
  LEFT JOIN (SELECT r.org, count(*) AS records, count(m.record_id) AS mapped,
     {R3("avg(floor(r.pk % 100 / 100.0 * 100 + 0.5) / 100)")} AS completeness,
     count(*) FILTER (WHERE len(n.uflags) > 0) AS uom_issues
     FROM raw r JOIN norm n ON n.record_id = r.record_id LEFT JOIN active m ON m.record_id = r.record_id GROUP BY r.org) s
  ON s.org = g.r_name LEFT JOIN pend p ON p.org = g.r_name""", ACTIVE, _norm_sql(), PENDING_ORG))
def q4(spark, d):
    x = Domain(spark, d)
    orgs = table(spark, d, "region").select(F.col("r_name").alias("org"))
    return D.org_scorecard(orgs, x.raw, light_norm(x), x.mappings, x.recs, x.tasks)


@query("q5_decision_timeline", oracle("""SELECT strftime(day, '%Y-%m-%d') AS day,
  count(*) FILTER (WHERE status = 'APPROVED') AS approved, count(*) FILTER (WHERE status = 'REJECTED') AS rejected
  FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-30' - INTERVAL 29 DAY, DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE)
        AS day) c LEFT JOIN recs ON decided_at = day GROUP BY day"""))
def q5(spark, d):
    return D.decision_timeline(Domain(spark, d).recs, "2024-01-30")


@query("q6_flag_histogram", oracle("SELECT flag, count(*) AS n FROM (SELECT unnest(uflags) AS flag FROM norm) GROUP BY flag",
                                   _norm_sql()))
def q6(spark, d):
    return D.flag_histogram(light_norm(Domain(spark, d)))


@query("q6_batch_flags", oracle("""SELECT flag, count(*) AS n FROM (SELECT unnest(uflags) AS flag FROM norm
  WHERE batch_id = 'B4') GROUP BY flag""", _norm_sql()))
def q6b(spark, d):
    x = Domain(spark, d)
    return D.batch_flag_histogram(light_norm(x), x.raw, "B4")


@query("q7_funnel", oracle("""SELECT (SELECT count(*) FROM raw) AS ingested, (SELECT count(*) FROM raw) AS normalized,
  (SELECT count(*) FROM raw WHERE family <> 'UNCLASSIFIED') AS classified,
  (SELECT count(*) FROM (SELECT a_record_id FROM recs WHERE match_type <> 'NOT_MATCHED' UNION
     SELECT b_record_id FROM recs WHERE match_type <> 'NOT_MATCHED')) AS matched,
  (SELECT count(*) FROM active) AS harmonised""", ACTIVE))
def q7(spark, d):
    x = Domain(spark, d)
    return D.funnel(x.raw, light_norm(x), x.recs, x.mappings)


@query("q10_canonical_list", oracle("""SELECT c.cnmc, c.status, count(m.record_id) AS mappings,
  coalesce(array_to_string(list_sort(list(DISTINCT m.org) FILTER (WHERE m.org IS NOT NULL)), ','), '') AS orgs
  FROM canonical c LEFT JOIN active m ON m.cnmc = c.cnmc GROUP BY c.cnmc, c.status""", ACTIVE))
def q10(spark, d):
    x = Domain(spark, d)
    return D.canonical_list(x.canonical, x.mappings).select(
        "cnmc", "status", "mappings", F.array_join("orgs", ",").alias("orgs"))


LIVE = "live AS (SELECT * FROM recs WHERE status IN ('PENDING', 'NEEDS_INFO') AND routing <> 'NONE')"


@query("q11_pending_reviews", oracle("""SELECT record_id, count(*) AS n FROM (SELECT a_record_id AS record_id FROM live
  UNION ALL SELECT b_record_id FROM live) GROUP BY record_id""", LIVE))
def q11(spark, d):
    return D.pending_reviews(Domain(spark, d).recs)


@query("q12_queue_counts", oracle(f"""SELECT k, coalesce(n, 0) AS n FROM (SELECT unnest(['FAST_TRACK', 'FULL_REVIEW',
  'UNRESOLVED', 'VETOED', 'DECIDED']) AS k) LEFT JOIN (SELECT queue AS k, count(*) AS n FROM tasks WHERE {WAITING} GROUP BY 1
  UNION ALL SELECT 'VETOED', count(*) FROM recs WHERE vetoed
  UNION ALL SELECT 'DECIDED', count(*) FROM recs WHERE status IN ('APPROVED', 'REJECTED')) USING (k)"""))
def q12(spark, d):
    x = Domain(spark, d)
    return D.queue_counts(x.recs, x.tasks)


@query("q15_action_counts", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def q15(spark, d):
    return D.count_by(_events(spark, d), "action")


@query("q19_price_dispersion", oracle(f"""SELECT m.cnmc, count(*) AS price_points, min(price) AS min_price,
  max(price) AS max_price, {R3('(max(price) - min(price)) / min(price) * 100')} AS spread_pct FROM active m
  JOIN raw r ON r.record_id = m.record_id WHERE price <> 0 GROUP BY m.cnmc HAVING count(*) >= 2""", ACTIVE))
def q19(spark, d):
    x = Domain(spark, d)
    return D.price_dispersion(x.mappings, x.raw)


@query("q20_mapping_groups", oracle("""SELECT c.cnmc, c.status, array_to_string(list_sort(list(concat(m.org, ':',
  m.legacy_code, ':', m.status))), ',') AS mappings FROM canonical c JOIN mappings m ON m.cnmc = c.cnmc
  GROUP BY c.cnmc, c.status"""))
def q20(spark, d):
    x = Domain(spark, d)
    return V.mapping_groups(x.mappings, x.raw, x.canonical).select("cnmc", "status", F.array_join(F.array_sort(F.transform(
        "mappings", lambda m: F.concat_ws(":", m["org"], m["legacy_code"], m["status"]))), ",").alias("mappings"))


@query("q21_open_reviews", oracle(f"SELECT count(*) FILTER (WHERE {WAITING}) AS open_reviews FROM tasks"))
def q21(spark, d):
    return D.open_review_count(Domain(spark, d).tasks)


@query("q22_consolidation", oracle(f"""SELECT kind, key, count(*) AS records, count(m.record_id) AS mapped,
  {R3('count(m.record_id) / CAST(count(*) AS DOUBLE)')} AS ratio FROM (SELECT 'ORG' AS kind, org AS key, record_id FROM raw
  UNION ALL SELECT 'CATEGORY', family, record_id FROM raw) r LEFT JOIN active m ON m.record_id = r.record_id
  GROUP BY kind, key""", ACTIVE))
def q22(spark, d):
    x = Domain(spark, d)
    return D.consolidation(x.raw, light_norm(x), x.mappings, x.canonical)


JUDGED = """judged AS (SELECT a_record_id, b_record_id, match_type, vetoed, ta.k = tb.k AS same, ta.k AS k FROM recs
  JOIN truth ta ON ta.record_id = a_record_id JOIN truth tb ON tb.record_id = b_record_id)"""
# some records of the last organisation belong to another material, so wrong pairs exist
TRUTH = "truth AS (SELECT record_id, concat('T', pk, CASE WHEN rg = 4 AND pk % 4 = 0 THEN 'x' ELSE '' END) AS k FROM raw)"


def _truth(x):
    odd = F.when((F.col("rg") == 4) & (F.col("pk") % 4 == 0), F.lit("x")).otherwise(F.lit(""))
    return x.raw.select("record_id", F.concat(F.lit("T"), "pk", odd).alias("truth_key"))


@query("q16_pair_quality", oracle(f"""SELECT (SELECT count(*) FROM truth) AS evaluated_records,
  (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM truth GROUP BY k)) AS truth_pairs,
  count(*) FILTER (WHERE {POS} AND same) AS true_positives, count(*) FILTER (WHERE {POS} AND NOT same) AS false_positives,
  {R3(f"count(*) FILTER (WHERE {POS} AND same) / CAST(count(*) FILTER (WHERE {POS}) AS DOUBLE)")} AS precision,
  {R3(f"count(*) FILTER (WHERE {POS} AND same) / CAST((SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM truth GROUP BY k)) AS DOUBLE)")} AS pair_recall
  FROM judged""", TRUTH, JUDGED))
def q16(spark, d):
    x = Domain(spark, d)
    return E.evaluate(x.recs, _truth(x)).select(
        "evaluated_records", "truth_pairs", "true_positives", "false_positives",
        half_up(F.col("precision")).alias("precision"), half_up(F.col("pair_recall")).alias("pair_recall"))


@query("q17_cluster_recall", oracle("""SELECT sum(n * (n - 1) // 2) AS cluster_pairs FROM (SELECT t.k, c.root, count(*) AS n
  FROM (SELECT node, min(root) AS root FROM reach GROUP BY node) c JOIN truth t ON t.record_id = c.node
  GROUP BY t.k, c.root)""", TRUTH, JUDGED, f"""sym AS (SELECT a_record_id AS u, b_record_id AS v FROM judged
  WHERE same AND {POS} UNION SELECT b_record_id, a_record_id FROM judged WHERE same AND {POS})""",
    "reach AS (SELECT u AS node, u AS root FROM sym UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node)"))
def q17(spark, d):
    x = Domain(spark, d)
    return E.cluster_pairs(E.judged_pairs(x.recs, _truth(x)), E._truth(_truth(x)))


@query("q18_confusion", oracle("""SELECT count(*) FILTER (WHERE match_type = 'FUNCTIONALLY_EQUIVALENT' AND same) AS
  functional_same, count(*) FILTER (WHERE match_type = 'FUNCTIONALLY_EQUIVALENT' AND NOT same) AS functional_different,
  count(*) FILTER (WHERE vetoed AND NOT same) AS veto_correct, count(*) FILTER (WHERE vetoed AND same) AS veto_wrong
  FROM judged""", TRUTH, JUDGED))
def q18(spark, d):
    x = Domain(spark, d)
    return E.evaluate(x.recs, _truth(x)).select("functional_same", "functional_different", "veto_correct", "veto_wrong")


# ------------------------------------------------------------------------------------------------------- views
@query("x1_record_grid", oracle("""SELECT r.record_id, r.org, r.legacy_code, r.family AS category, m.cnmc,
  coalesce(p.n, 0) AS pending_reviews FROM raw r LEFT JOIN active m ON m.record_id = r.record_id
  LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT a_record_id AS id FROM live UNION ALL SELECT b_record_id FROM live)
  GROUP BY id) p ON p.id = r.record_id""", ACTIVE, LIVE))
def x1(spark, d):
    x = Domain(spark, d)
    grid = V.record_grid(x.raw.select("record_id", "org", "legacy_code"), light_norm(x).select("record_id", "category"),
                         x.mappings, x.recs)
    return grid.select("record_id", "org", "legacy_code", "category", "cnmc", "pending_reviews")


@query("p4_grid_filter", oracle("""SELECT r.record_id FROM raw r LEFT JOIN active m ON m.record_id = r.record_id
  WHERE m.record_id IS NULL AND r.family = 'VALVE' AND r.batch_id = 'B1'""", ACTIVE))
def p4(spark, d):
    x = Domain(spark, d)
    grid = V.record_grid(x.raw.select("record_id", "org", "batch_id"), light_norm(x).select("record_id", "category"),
                         x.mappings, x.recs)
    return V.filter_grid(grid, batch="B1", category="VALVE", state="unmapped").select("record_id")


@query("p5_contains", oracle("SELECT record_id, description FROM raw WHERE description ILIKE '%valve%dn100%'"))
def p5(spark, d):
    return Domain(spark, d).raw.filter(F.col("description").ilike("%valve%dn100%")).select("record_id", "description")


@query("p6_uom_issue_rows", oracle("SELECT record_id FROM norm WHERE len(uflags) > 0", _norm_sql()))
def p6(spark, d):
    return light_norm(Domain(spark, d)).filter(D.has_uom_issue(F.col("flags"))).select("record_id")


@query("p7_strip_internal", """SELECT event_id, concat('{"k":"', json_extract_string(props, '$.k'), '"}') AS payload
  FROM events""")
def p7(spark, d):
    e = table(spark, d, "events")
    tagged = F.regexp_replace("props", r"\}$", ', "_seed": "hidden"}')
    return e.select("event_id", V.strip_internal(tagged).alias("payload"))


@query("p8_ledger_page", """SELECT event_id, event_type FROM events WHERE event_type = 'error'
  AND event_id < (SELECT max(event_id) FROM events) ORDER BY event_id DESC LIMIT 500""")
def p8(spark, d):
    from ..operators.ledger import search_ledger

    e = table(spark, d, "events").withColumnsRenamed({"event_id": "seq", "event_type": "action"})
    last = e.agg(F.max("seq")).first()[0]
    return search_ledger(e, action="error", before=last).select(
        F.col("seq").alias("event_id"), F.col("action").alias("event_type"))


@query("p9_find_canonical", oracle("SELECT cnmc, short_code FROM canonical WHERE short_code = 'NMC-12' OR cnmc = 'NMC-12'"))
def p9(spark, d):
    c = Domain(spark, d).canonical.withColumn("canonical_id", F.sha2("cnmc", 256))
    return V.find_canonical("NMC-12", c).select("cnmc", "short_code")


@query("p11_any_column", """SELECT p_partkey, p_name FROM part WHERE concat_ws(' ', p_name, p_brand, p_type) ILIKE
  '%bolt brand#1%'""")
def p11(spark, d):
    from ..functions.expr import any_column_contains

    p = table(spark, d, "part")
    return p.filter(any_column_contains(["p_name", "p_brand", "p_type"], "bolt brand#1")).select("p_partkey", "p_name")


BOTH = """sided AS (SELECT x.*, a.legacy_code AS a_code, a.org AS a_org, b.legacy_code AS b_code, b.org AS b_org FROM recs x
  JOIN raw a ON a.record_id = x.a_record_id JOIN raw b ON b.record_id = x.b_record_id)"""


@query("k5_both_sides", oracle("SELECT pair_key, a_code, a_org, b_code, b_org FROM sided", BOTH))
def k5(spark, d):
    x = Domain(spark, d)
    return V.both_sides(x.recs, x.raw).select("pair_key", "a_code", "a_org", "b_code", "b_org")


@query("x4_review_queue", oracle("""SELECT x.pair_key, priority, final_score, a_code, b_code FROM sided x JOIN tasks t
  ON t.pair_key = x.pair_key WHERE t.queue = 'FULL_REVIEW' AND t.status IN ('OPEN', 'NEEDS_INFO')
  ORDER BY priority, final_score DESC, x.pair_key LIMIT 600""", BOTH))
def x4(spark, d):
    x = Domain(spark, d)
    return V.review_queue("FULL_REVIEW", x.recs, x.raw, x.tasks).select(
        "pair_key", "priority", "final_score", "a_code", "b_code")


@query("x4_vetoed_tab", oracle("""SELECT pair_key, raw_score FROM recs WHERE vetoed ORDER BY raw_score DESC, pair_key
  LIMIT 400"""))
def x4v(spark, d):
    x = Domain(spark, d)
    return V.review_queue("VETOED", x.recs, x.raw, x.tasks).select("pair_key", "raw_score")


@query("w5_next_in_queue", oracle("""SELECT x.pair_key FROM recs x JOIN tasks t ON t.pair_key = x.pair_key
  WHERE t.queue = 'FAST_TRACK' AND t.status = 'OPEN' ORDER BY priority, final_score DESC, x.pair_key LIMIT 1"""))
def w5(spark, d):
    x = Domain(spark, d)
    return V.next_in_queue("FAST_TRACK", x.recs, x.tasks)


@query("w3_order_report", """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
  ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey""")
def w3(spark, d):
    o = table(spark, d, "orders")
    return o.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select(
        "o_orderkey", "o_orderpriority", "o_totalprice")


@query("x6_exact_lookup", oracle("""SELECT r.record_id, r.legacy_code, m.cnmc FROM raw r LEFT JOIN active m
  ON m.record_id = r.record_id LEFT JOIN canonical c ON c.cnmc = m.cnmc WHERE r.legacy_code ILIKE '%m12%'
  OR m.cnmc ILIKE '%m12%' OR c.short_code ILIKE '%m12%' ORDER BY r.org, r.legacy_code, r.record_id LIMIT 25""", ACTIVE))
def x6(spark, d):
    x = Domain(spark, d)
    return V.exact_lookup("m12", x.raw, x.mappings, x.canonical).select("record_id", "legacy_code", "cnmc")


@query("x7_code_lookup", oracle("""SELECT q.org, q.legacy_code, CASE WHEN m.cnmc IS NULL THEN 'NOT_YET_HARMONISED' ELSE
  'HARMONISED' END AS status, m.cnmc, coalesce((SELECT count(*) FROM active s WHERE s.cnmc = m.cnmc
  AND s.record_id <> q.record_id), 0) AS n_siblings FROM raw q LEFT JOIN active m ON m.record_id = q.record_id""", ACTIVE))
def x7(spark, d):
    x = Domain(spark, d)
    requests = x.raw.select(F.lower("org").alias("org"), "legacy_code")
    return V.lookup_codes(requests, x.raw, x.mappings, x.canonical).select(
        "org", "legacy_code", "status", "cnmc", F.size("siblings").alias("n_siblings"))


@query("x2_record_detail", oracle("""SELECT r.record_id, m.cnmc, (SELECT array_to_string(list(pair_key), ',') FROM
  (SELECT pair_key FROM recs WHERE r.record_id IN (a_record_id, b_record_id) ORDER BY final_score DESC, pair_key LIMIT 12))
  AS recommendations FROM raw r LEFT JOIN active m ON m.record_id = r.record_id WHERE r.legacy_code = 'M8-1'""", ACTIVE))
def x2(spark, d):
    x = Domain(spark, d)
    rid = x.raw.filter("legacy_code = 'M8-1'").select("record_id").first()[0]
    raw = x.raw.select("record_id", "legacy_code", F.lit("{}").alias("payload"))
    one = V.record_detail(rid, raw, light_norm(x).select("record_id", "category"), x.mappings, x.canonical, x.recs)
    return one.select("record_id", "cnmc", F.array_join(F.transform(
        "recommendations", lambda r: r["pair_key"]), ",").alias("recommendations"))


@query("x9_last_run", """SELECT event_id AS run_id, event_type AS model_id FROM events ORDER BY ts DESC, event_id LIMIT 1""")
def x9(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("model_id"))
    return V.last_run(runs, e.select(F.col("event_type").alias("model_id")).distinct()).select("run_id", "model_id")


@query("k3_unmapped_records", oracle("SELECT record_id FROM raw WHERE record_id NOT IN (SELECT record_id FROM active)", ACTIVE))
def k3(spark, d):
    x = Domain(spark, d)
    return x.raw.join(x.mappings.filter("status = 'ACTIVE'"), "record_id", "left_anti").select("record_id")


@query("setop_union_distinct", oracle("SELECT org AS name FROM raw UNION SELECT family FROM raw"))
def setop(spark, d):
    x = Domain(spark, d)
    return x.raw.select(F.col("org").alias("name")).union(x.raw.select("family")).distinct()
