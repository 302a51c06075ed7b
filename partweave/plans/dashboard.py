"""Dashboard measures (Q1-Q12, Q14-Q15, Q19-Q22).  Each function is joins and aggregates over the engine's tables.

Columns used: raw(record_id, org, batch_id, price, qty), norm(record_id, category, completeness, flags,
missing_required, expansions), recs(pair_key, a_record_id, b_record_id, category, match_type, vetoed, status, routing,
decided_at), tasks(pair_key, queue, priority, status), mappings(record_id, cnmc, org, legacy_code, status),
canonical(cnmc, category, status), events(action)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..masters import POSITIVE
from ..functions.expr import half_up

WAITING = ["OPEN", "NEEDS_INFO"]
UOM_ISSUE = "^UOM_(NONSTANDARD|DIMENSION|AMBIGUOUS|UNRECOGNISED|MISSING)"
MATCH_TYPE_ORDER = ["IDENTICAL", "DUPLICATE", "NEAR_DUPLICATE", "FUNCTIONALLY_EQUIVALENT",
                    "RELATED_BUT_NOT_EQUIVALENT", "INSUFFICIENT_DATA", "NOT_MATCHED"]


def has_uom_issue(flags: Column) -> Column:
    """P6"""
    return F.exists(flags, lambda f: f.rlike(UOM_ISSUE))


def kpi_totals(raw, norm, recs, tasks, mappings, canonical, events) -> DataFrame:
    """Q1 - one row of totals; every table is read once and reduced to one row before they are put side by side."""
    n = F.count("*")
    parts = [
        raw.agg(n.alias("records"), F.countDistinct("org").alias("orgs")),
        canonical.agg(F.count_if(F.col("status") == "APPROVED").alias("canonical")),
        mappings.agg(F.count_if(F.col("status") == "ACTIVE").alias("mapped")),
        recs.agg(F.count_if(F.col("match_type").isin(POSITIVE)).alias("duplicates"),
                 F.count_if(F.col("match_type") == "FUNCTIONALLY_EQUIVALENT").alias("functional"),
                 F.count_if("vetoed").alias("vetoes"),
                 F.count_if(F.col("status") == "APPROVED").alias("approved"),
                 F.count_if(F.col("status") == "REJECTED").alias("rejected")),
        tasks.agg(F.count_if(F.col("status").isin(WAITING)).alias("pending")),
        norm.agg(F.count_if(F.size("missing_required") > 0).alias("insufficient"),
                 F.count_if(F.col("category") == "UNCLASSIFIED").alias("unclassified"),
                 F.count_if(has_uom_issue(F.col("flags"))).alias("uom_issues"),
                 F.coalesce(F.sum(F.size("expansions")), F.lit(0)).alias("abbreviations"),
                 half_up(F.avg(F.when(F.col("category") != "UNCLASSIFIED", F.col("completeness")))).alias(
                     "completeness")),
        events.agg(n.alias("audit_events")),
    ]
    one = reduce(lambda a, b: a.crossJoin(b), parts)     # seven one-row frames
    return one.withColumn("code_reduction", F.when(
        F.col("mapped") > 0, 1 - F.col("canonical") / F.col("mapped")).otherwise(0.0))


def category_breakdown(norm, mappings, canonical, recs, tasks) -> DataFrame:
    """Q2 - per family, with remaining records and share mapped."""
    active = mappings.filter("status = 'ACTIVE'").select("record_id", F.lit(1).alias("_m"))
    base = norm.join(active, "record_id", "left").groupBy("category").agg(
        F.count("*").alias("records"), F.count("_m").alias("mapped"))
    canon = canonical.filter("status = 'APPROVED'").groupBy("category").agg(F.count("*").alias("canonical"))
    waiting = tasks.filter(F.col("status").isin(WAITING)).select("pair_key")
    pending = recs.join(waiting, "pair_key").groupBy("category").agg(F.count("*").alias("pending"))
    dup = recs.filter(F.col("match_type").isin(POSITIVE)).groupBy("category").agg(F.count("*").alias("duplicates"))
    out = reduce(lambda a, b: a.join(b, "category", "left"), [base, canon, pending, dup]).na.fill(
        0, ["canonical", "pending", "duplicates"])
    return out.withColumns({
        "remaining": F.greatest(F.lit(0), F.col("records") - F.col("mapped")),
        "pct_mapped": F.coalesce(half_up(F.try_divide(F.col("mapped"), F.col("records"))), F.lit(0.0))})


def match_type_histogram(recs) -> DataFrame:
    """Q3 - non-empty match types in severity order."""
    place = F.array_position(F.array(*[F.lit(t) for t in MATCH_TYPE_ORDER]), F.col("match_type"))
    return recs.groupBy("match_type").agg(F.count("*").alias("n")).withColumn("ordinal", place.cast("int"))


def pending_per_org(raw, recs, tasks) -> DataFrame:
    """K8 - waiting pairs that touch an organisation on either side, each pair once per organisation."""
    waiting = recs.join(tasks.filter(F.col("status").isin(WAITING)).select("pair_key"), "pair_key").select(
        "pair_key", F.explode(F.array("a_record_id", "b_record_id")).alias("record_id"))
    return waiting.join(raw.select("record_id", "org"), "record_id").select("pair_key", "org").distinct().groupBy(
        "org").agg(F.count("*").alias("pending"))


def org_scorecard(orgs, raw, norm, mappings, recs, tasks) -> DataFrame:
    """Q4 - one row per organisation, organisations without records included."""
    active = mappings.filter("status = 'ACTIVE'").select("record_id", F.lit(1).alias("_m"))
    facts = raw.select("record_id", "org").join(norm.select("record_id", "completeness", "flags"), "record_id", "left"
                                                ).join(active, "record_id", "left")
    per = facts.groupBy("org").agg(
        F.count("*").alias("records"), F.count("_m").alias("mapped"), F.avg("completeness").alias("_c"),
        F.count_if(F.coalesce(has_uom_issue(F.col("flags")), F.lit(False))).alias("uom_issues"))
    return orgs.select("org").join(per, "org", "left").join(pending_per_org(raw, recs, tasks), "org", "left").select(
        "org", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "mapped", "pending")],
        F.coalesce(half_up(F.col("_c")), F.lit(0.0)).alias("completeness"),
        F.coalesce("uom_issues", F.lit(0)).alias("uom_issues"))


def decision_timeline(recs, as_of: str, days: int = 30) -> DataFrame:
    """Q5 - zero-filled calendar of approvals and rejections ending at ``as_of``."""
    spark = recs.sparkSession
    last = F.to_date(F.lit(as_of))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    daily = recs.filter(F.col("status").isin("APPROVED", "REJECTED") & F.to_date("decided_at").between(
        F.date_sub(last, days - 1), last)).groupBy(F.to_date("decided_at").alias("day")).agg(
        F.count_if(F.col("status") == "APPROVED").alias("approved"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"))
    return calendar.join(daily, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("approved", F.lit(0)).alias("approved"),
        F.coalesce("rejected", F.lit(0)).alias("rejected"))


def flag_histogram(norm) -> DataFrame:
    """Q6/K9 - records per quality flag, the part after ':' ignored."""
    return norm.select(F.explode("flags").alias("f")).groupBy(
        F.split_part("f", F.lit(":"), F.lit(1)).alias("flag")).agg(F.count("*").alias("n"))


def batch_flag_histogram(norm, raw, batch_id: str) -> DataFrame:
    """Q6 for one batch."""
    return flag_histogram(norm.join(raw.filter(F.col("batch_id") == batch_id).select("record_id"), "record_id",
                                    "left_semi"))


def funnel(raw, norm, recs, mappings) -> DataFrame:
    """Q7"""
    seen = recs.filter("match_type <> 'NOT_MATCHED'")
    matched = seen.select(F.col("a_record_id").alias("id")).union(seen.select("b_record_id")).distinct()
    parts = [raw.agg(F.count("*").alias("ingested")),
             norm.agg(F.count("*").alias("normalized"),
                      F.count_if(~F.col("category").isin("UNCLASSIFIED", "PENDING")).alias("classified")),
             matched.agg(F.count("*").alias("matched")),
             mappings.agg(F.count_if(F.col("status") == "ACTIVE").alias("harmonised"))]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def opportunities(canonical, mappings, raw, min_orgs: int = 3) -> DataFrame:
    """Q8/Q9 - demand that several organisations could buy together, with saving tier and price spread."""
    facts = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc", "org").join(
        raw.select("record_id", "price", "qty"), "record_id").join(
        canonical.filter("status = 'APPROVED'").select("cnmc", "category"), "cnmc")
    groups = facts.groupBy("cnmc", "category").agg(
        F.countDistinct("org").alias("orgs"), F.count("*").alias("codes"),
        F.array_join(F.array_sort(F.collect_set("org")), ",").alias("org_codes"),
        F.coalesce(F.sum(F.col("price") * F.col("qty")), F.lit(0.0)).alias("spend"),
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), F.count("price").alias("price_points")).filter(F.col("orgs") >= min_orgs)
    rate = F.when(F.col("orgs") >= 5, 0.12).when(F.col("orgs") == 4, 0.1).otherwise(0.08)
    return groups.withColumns({
        "est_saving": F.col("spend") * rate,
        "price_spread": F.when((F.col("min_price") != 0) & (F.col("max_price") != 0),
                               (F.col("max_price") - F.col("min_price")) / F.col("min_price"))})


def opportunity_totals(opps: DataFrame) -> DataFrame:
    return opps.agg(F.count("*").alias("groups"), F.coalesce(F.sum("spend"), F.lit(0.0)).alias("total_spend"),
                    F.coalesce(F.sum("est_saving"), F.lit(0.0)).alias("total_saving"))


def canonical_list(canonical, mappings) -> DataFrame:
    """Q10 - active mapping count and organisations per canonical."""
    per = mappings.filter("status = 'ACTIVE'").groupBy("cnmc").agg(
        F.count("*").alias("mappings"), F.array_sort(F.collect_set("org")).alias("orgs"))
    return canonical.join(per, "cnmc", "left").withColumns({
        "mappings": F.coalesce("mappings", F.lit(0)),
        "orgs": F.coalesce("orgs", F.array().cast("array<string>"))})


def pending_reviews(recs) -> DataFrame:
    """Q11 - open routed pairs per record, both sides counted."""
    live = recs.filter(F.col("status").isin("PENDING", "NEEDS_INFO") & (F.col("routing") != "NONE"))
    return live.select(F.explode(F.array("a_record_id", "b_record_id")).alias("record_id")).groupBy("record_id").agg(
        F.count("*").alias("n"))


def queue_counts(recs, tasks) -> DataFrame:
    """Q12 - open tasks per queue, vetoed and decided pairs; empty queues show 0."""
    spark = recs.sparkSession
    keys = spark.createDataFrame([(k,) for k in ("FAST_TRACK", "FULL_REVIEW", "UNRESOLVED", "VETOED", "DECIDED")],
                                 "k string")
    queued = tasks.filter(F.col("status").isin(WAITING)).groupBy(F.col("queue").alias("k")).agg(F.count("*").alias("n"))
    marks = recs.select(F.explode(F.array_compact(F.array(
        F.when(F.col("vetoed"), F.lit("VETOED")),
        F.when(F.col("status").isin("APPROVED", "REJECTED"), F.lit("DECIDED"))))).alias("k")).groupBy("k").agg(
        F.count("*").alias("n"))
    return keys.join(queued.unionByName(marks), "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


def open_review_count(tasks) -> DataFrame:
    """Q21"""
    return tasks.agg(F.count_if(F.col("status").isin(WAITING)).alias("open_reviews"))


def consolidation(raw, norm, mappings, canonical) -> DataFrame:
    """Q22 - mapped share per organisation and family, and codes per canonical per family."""
    active = mappings.filter("status = 'ACTIVE'").select("record_id", F.lit(1).alias("_m"))
    facts = raw.select("record_id", "org").join(norm.select("record_id", "category"), "record_id").join(
        active, "record_id", "left")
    ratio = lambda key, kind: facts.groupBy(F.col(key).alias("key")).agg(
        F.count("*").alias("records"), F.count("_m").alias("mapped")).withColumn("kind", F.lit(kind))
    both = ratio("org", "ORG").unionByName(ratio("category", "CATEGORY"))
    return both.select("kind", "key", "records", "mapped",
                       half_up(F.try_divide(F.col("mapped"), F.col("records"))).alias("ratio"))


def price_dispersion(mappings, raw) -> DataFrame:
    """Q19 - min, max and spread over the non-zero prices of every group with at least two of them."""
    priced = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc").join(
        raw.filter("price is not null and price <> 0").select("record_id", "price"), "record_id")
    return priced.groupBy("cnmc").agg(
        F.count("*").alias("price_points"), F.min("price").alias("min_price"), F.max("price").alias("max_price")).filter(
        "price_points >= 2").withColumn("spread_pct", half_up(
            (F.col("max_price") - F.col("min_price")) / F.col("min_price") * 100))


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Q15"""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def stage_metrics(norm) -> DataFrame:
    """Q14 - what the normalise and classify stages report, in one pass."""
    return norm.agg(
        F.count("*").alias("normalized"), F.coalesce(F.sum(F.size("expansions")), F.lit(0)).alias("abbreviations"),
        F.count_if(F.exists("flags", lambda f: f.startswith("UOM_"))).alias("uom_issues"),
        F.count_if(F.size("missing_required") > 0).alias("insufficient"),
        F.coalesce(F.sum(F.size(F.map_keys("attributes"))), F.lit(0)).alias("attributes"))
