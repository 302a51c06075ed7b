"""Decisions, codes and values (G*, W*, A*) over the derived pairs and mappings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import govern as G
from ..operators.ledger import action_facets, search_ledger
from .base import Domain, oracle, query, table

DECISIONS = """SELECT pair_key, CASE pk % 6 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'EDIT' WHEN 3 THEN 'REQUEST_INFO'
  WHEN 4 THEN 'ARCHIVE' ELSE 'APPROVE' END AS action, CASE WHEN pk % 4 = 0 THEN 'not the same' WHEN pk % 4 = 1 THEN 'no' END AS note,
  pk AS decided_at FROM {recs} x"""


@query("g1_validated_decisions", oracle("""SELECT d.pair_key, d.action,
  CASE WHEN e IS NULL THEN CASE WHEN d.action IN ('APPROVE', 'EDIT') THEN 'APPROVED' WHEN d.action = 'REJECT' THEN 'REJECTED'
    ELSE 'NEEDS_INFO' END END AS outcome, e AS error FROM (SELECT d.*,
    CASE WHEN d.action = 'ARCHIVE' THEN 'Unknown action'
      WHEN r.status NOT IN ('PENDING', 'NEEDS_INFO') THEN concat('Recommendation already ', lower(r.status))
      WHEN d.action = 'REJECT' AND length(trim(coalesce(note, ''))) < 5 THEN 'A rejection reason is required'
      WHEN d.action = 'REQUEST_INFO' AND coalesce(note, '') = '' THEN 'Describe the required information'
      WHEN d.action IN ('APPROVE', 'EDIT') AND vetoed THEN 'A hard-exclusion veto is active on this pair'
      WHEN d.action IN ('APPROVE', 'EDIT') AND match_type NOT IN """ + "(" + ", ".join(
    f"'{t}'" for t in sorted(G.APPROVABLE)) + """) THEN concat(match_type, ' recommendations cannot be approved') END AS e
    FROM (""" + DECISIONS.format(recs="recs") + """) d JOIN recs r USING (pair_key)) d"""))
def g1(spark, d):
    recs = Domain(spark, d).recs
    return G.validate_decisions(spark.sql(DECISIONS, recs=recs), recs).select("pair_key", "action", "outcome", "error")


@query("g5_short_codes", oracle("""SELECT legacy_code, concat('NMC-BRG-', lpad(CAST(pk AS VARCHAR), 6, '0')) AS short_code FROM raw"""))
def g5(spark, d):
    return Domain(spark, d).raw.select("legacy_code", G.short_code(F.lit("BRG"), F.col("pk")).alias("short_code"))


@query("g6_free_codes", oracle("""SELECT pk, CASE WHEN n = 1 THEN base ELSE concat(base, '-V', n) END AS cnmc FROM (
  SELECT pk, base, k + CASE WHEN k = 1 THEN (SELECT count(*) FROM t WHERE t.base = c.base AND s = 1)
    + CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.base = c.base AND s = 1) AND EXISTS (SELECT 1 FROM t WHERE t.base = c.base AND s = 2)
      THEN 1 ELSE 0 END ELSE 0 END AS n FROM c WHERE k = 1)""",
       "t AS (SELECT concat('IN-', p_brand) AS base, unnest([1, 3]) AS s FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand)",
       "c AS (SELECT p_partkey AS pk, concat('IN-', p_brand) AS base, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)"))
def g6(spark, d):
    """The first new row of every base; bases exist as they are and with -V3, so -V2 is free."""
    part = table(spark, d, "part")
    base = F.concat(F.lit("IN-"), "p_brand")
    old = part.filter("p_partkey % 3 = 0").select(base.alias("b")).distinct()
    existing = old.select(F.col("b").alias("cnmc")).unionAll(old.select(F.concat("b", F.lit("-V3")).alias("cnmc")))
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("pk"))
    return G.unique_codes(first.select("pk", base.alias("code"), F.col("pk").alias("component")), existing).select("pk", "cnmc")


@query("w6_numbers", oracle("""SELECT record_id, row_number() OVER (PARTITION BY org ORDER BY concat('IN-MAT-', record_id)) AS n FROM raw"""))
def w6(spark, d):
    """All order keys share a prefix; ranges split them anyway."""
    rows = Domain(spark, d).raw.select("record_id", "org", F.concat(F.lit("IN-MAT-"), "record_id").alias("code"))
    return G.number_within(rows, "org", "code").select("record_id", "n")


@query("g10_rolled_up_values", oracle("""SELECT cnmc, floor(sum(price * qty) * 100 + 0.5) / 100 AS value FROM mappings JOIN raw USING
  (record_id) WHERE status = 'ACTIVE' GROUP BY cnmc"""))
def g10(spark, d):
    of = Domain(spark, d)
    return G.rolled_up_values(of.mappings, of.raw).select("cnmc", (F.floor(F.col("value") * 100 + 0.5) / 100).alias("value"))


@query("g17_current_rules", """SELECT user_id AS rule_id, active FROM (SELECT user_id, event_type <> 'error' AS active,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type <> 'error' DESC) AS rn FROM events) WHERE rn = 1""")
def g17(spark, d):
    changes = table(spark, d, "events").select(F.col("user_id").alias("rule_id"), (F.col("event_type") != "error").alias("active"),
                                               F.col("ts").alias("changed_at"))
    return G.current_rules(changes).select("rule_id", "active")


@query("a4_ledger_facets", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def a4(spark, d):
    return action_facets(table(spark, d, "events").withColumnRenamed("event_type", "action"))


@query("a4_ledger_search", """SELECT event_id AS seq FROM events WHERE event_type = 'purchase' AND event_id < 5000
  AND contains(upper(props), 'A') ORDER BY event_id DESC LIMIT 800""")
def a4_search(spark, d):
    ledger = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.lit("").alias("actor"), F.lit("").alias("reason"),
        F.col("props").alias("payload"), F.lit("").alias("entity_id"))
    return search_ledger(ledger, text="a", action="purchase", before=5000, limit=800).select("seq")


@query("a4_ledger_search_text", """SELECT event_id AS seq FROM events WHERE contains(upper(props), '"K": 7')
  ORDER BY event_id DESC LIMIT 500""")
def a4_search_text(spark, d):
    """A text that occurs, over the events of every action and id."""
    ledger = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.lit("").alias("actor"), F.lit("").alias("reason"),
        F.col("props").alias("payload"), F.lit("").alias("entity_id"))
    return search_ledger(ledger, text='"k": 7').select("seq")


@query("p8_ledger_newest", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def p8_newest(spark, d):
    """The page that starts with the newest event."""
    ledger = table(spark, d, "events").withColumnsRenamed({"event_id": "seq", "event_type": "action"})
    return search_ledger(ledger).select(F.col("seq").alias("event_id"), F.col("action").alias("event_type"))
