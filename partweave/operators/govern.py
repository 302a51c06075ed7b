"""Decisions in bulk: validation, canonical groups, mappings, reversal, dictionary and rule revisions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import half_up
from ..masters import APPROVABLE, CLASSIFICATION_MASTER, SCHEMAS
from ..session import cut_lineage
from .components import connected_components
from .describe import canonical_description, is_generic_of, override_attributes, template_code
from .extract import by_family, value_text
from .extract.rules import MAP_TYPE

OPEN = ["PENDING", "NEEDS_INFO"]


# ---------------------------------------------------------------------------------------------------- decisions
def validate_decisions(decisions: DataFrame, recommendations: DataFrame, max_batch: int | None = None) -> DataFrame:
    """G1/G15 - one row per decision with ``outcome`` (APPROVED, REJECTED, NEEDS_INFO or NULL) and ``error``.

    decisions(pair_key, action, note); of several decisions about one pair only the first (by decided_at) counts."""
    if max_batch is not None and decisions.limit(max_batch + 1).count() > max_batch:
        raise ValueError(f"more than {max_batch} decisions in one batch")
    order = Window.partitionBy("pair_key").orderBy("decided_at", "action")
    recs = recommendations.select("pair_key", "status", "vetoed", "match_type", F.lit(True).alias("_found"))
    d = decisions.withColumn("_nth", F.row_number().over(order)).join(recs, "pair_key", "left")
    note = F.trim(F.coalesce(F.col("note"), F.lit("")))
    approve = F.col("action").isin("APPROVE", "EDIT")
    error = (
        F.when(F.col("_found").isNull(), F.lit("Recommendation not found"))
        .when(~F.col("action").isin("APPROVE", "EDIT", "REJECT", "REQUEST_INFO"), F.lit("Unknown action"))
        .when(~F.col("status").isin(OPEN), F.concat(F.lit("Recommendation already "), F.lower("status")))
        .when(F.col("_nth") > 1, F.lit("Recommendation already decided in this batch"))
        .when((F.col("action") == "REJECT") & (F.length(note) < 5), F.lit("A rejection reason is required"))
        .when((F.col("action") == "REQUEST_INFO") & (F.length(note) == 0), F.lit("Describe the required information"))
        .when(approve & F.col("vetoed"), F.lit("A hard-exclusion veto is active on this pair"))
        .when(approve & ~F.col("match_type").isin(APPROVABLE), F.concat(
            F.col("match_type"), F.lit(" recommendations cannot be approved")))
    )
    outcome = F.when(error.isNull(), F.when(approve, "APPROVED").when(F.col("action") == "REJECT", "REJECTED").otherwise(
        "NEEDS_INFO"))
    return d.withColumns({"outcome": outcome, "error": error}).drop("_nth", "_found", "status", "vetoed", "match_type")


# ---------------------------------------------------------------------------------------------- merged attributes
def merge_group_attributes(members: DataFrame, group: str = "component", order: str = "record_id") -> DataFrame:
    """G2 for groups of any size - (group, attributes), folded in record order without gathering the members.

    Per key the anchor's value is the earliest one; it is refined by the earliest value it is generic of (twice covers
    the longest generic chain of the vocabulary); among equal values the most confident evidence is kept."""
    cells = members.select(group, order, F.explode("attributes").alias("key", "attr")).filter(
        F.col("key") != "manufacturer")
    values = cells.groupBy(group, "key", F.col("attr.value_text").alias("value")).agg(
        F.min(order).alias("_at"),
        F.min_by("attr", F.struct((-F.col("attr.confidence")).alias("c"), F.col(order).alias("o"))).alias("attr"))
    current = values.groupBy(group, "key").agg(F.min_by(F.struct("value", "attr"), "_at").alias("cur"))
    for _ in range(2):
        finer = values.join(current, [group, "key"]).filter(
            is_generic_of(F.upper("cur.value"), F.upper("value"))).groupBy(group, "key").agg(
            F.min_by(F.struct("value", "attr"), "_at").alias("finer"))
        current = current.join(finer, [group, "key"], "left").select(
            group, "key", F.coalesce("finer", "cur").alias("cur"))
    return current.groupBy(group).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("key", F.col("cur.attr").alias("value"))))).alias("attributes"))


# ------------------------------------------------------------------------------------------------- codes and numbers
def number_within(df: DataFrame, group: str, order: str, start: Column | None = None, out: str = "n") -> DataFrame:
    """1, 2, 3 ... per group in ``order`` (W6) without sorting a whole group in one task: rows are dealt by ranges of
    (group, order), numbered inside a range, and offsets come from the counts of the ranges before.  The ranges are
    written before they are numbered, so a retried task cannot deal them anew."""
    d = cut_lineage(df.repartitionByRange(F.col(group), F.col(order)).withColumn("_b", F.spark_partition_id()))
    counts = d.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy(group, "_b").orderBy(order)
    value = F.row_number().over(inside)
    numbered = d.withColumn("_rn", value).join(offsets, [group, "_b"])
    return numbered.withColumn(out, (F.col("_off") + F.col("_rn") + (start if start is not None else F.lit(0))).cast(
        "bigint")).drop("_b", "_rn", "_off")


def short_code(prefix: Column, n: Column) -> Column:
    """G5"""
    return F.concat(F.lit("NMC-"), prefix, F.lit("-"), F.lpad(n.cast("string"), 6, "0"))


def unique_codes(new: DataFrame, existing_codes: DataFrame, base: str = "code", order: str = "component") -> DataFrame:
    """G6 - base, base-V2, base-V3 ...: the n-th new row of a base takes the n-th suffix that is free.

    A code counts as its own base (suffix 1) and, if it ends in -V<n>, as suffix n of what stands before; the k-th free
    number is k plus the taken numbers t_i (ascending) with t_i - i < k."""
    number = F.regexp_extract("cnmc", r"-V(\d+)$", 1).try_cast("int")
    plain = existing_codes.select(F.col("cnmc").alias(base), F.lit(1).alias("_s"))
    numbered = existing_codes.select(F.regexp_replace("cnmc", r"-V\d+$", "").alias(base), number.alias("_s")).filter("_s > 1")
    taken = plain.unionByName(numbered).groupBy(base).agg(F.sort_array(F.collect_set("_s")).alias("_taken"))
    w = Window.partitionBy(base).orderBy(order)
    joined = new.join(taken, base, "left").withColumn("_k", F.row_number().over(w))
    before = F.size(F.filter("_taken", lambda t, i: t - i - 1 < F.col("_k")))
    n = F.col("_k") + F.when(F.col("_taken").isNull(), 0).otherwise(before)
    return joined.withColumn("_n", n).drop("_k").withColumn("cnmc", F.when(
        F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-V"), F.col("_n").cast("string")))).drop(
        "_taken", "_n")


def taxonomy(df: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """G7 - unspsc by (category, subtype), then category, then the family default."""
    spark = df.sparkSession
    m = master if master is not None else spark.createDataFrame(
        [(c, s, u) for c, s, u, _ in CLASSIFICATION_MASTER], "category string, subtype string, unspsc string")
    exact = F.broadcast(m.filter("subtype is not null").select("category", "subtype", F.col("unspsc").alias("_u1")))
    general = F.broadcast(m.filter("subtype is null").select("category", F.col("unspsc").alias("_u2")))
    default = by_family(F.col("category"), lambda s: F.lit(s.unspsc))
    return df.join(exact, ["category", "subtype"], "left").join(general, "category", "left").withColumn(
        "unspsc", F.coalesce("_u1", "_u2", default)).drop("_u1", "_u2")


def base_unit(a: Column, b: Column) -> Column:
    """G19"""
    return F.coalesce(a, b)


# ------------------------------------------------------------------------------------------------ applying decisions
@dataclass
class Applied:
    outcomes: DataFrame          # one row per decision
    canonical: DataFrame         # snapshot after the batch
    mappings: DataFrame
    recommendations: DataFrame


def apply_decisions(decisions: DataFrame, recommendations: DataFrame, records: DataFrame, mappings: DataFrame,
                    canonical: DataFrame, at: str) -> Applied:
    """G8-G13 - apply a batch of decisions; the result does not depend on their order.

    decisions(pair_key, action, note, decided_at, edit_description, edit_attributes map or NULL)
    recommendations(pair_key, a_record_id, b_record_id, category, match_type, final_score, vetoed, status,
                    proposed_cnmc, proposed_description, decision_note)
    records(record_id, org, legacy_code, category, attributes, base_uom, price, qty)
    mappings(record_id, cnmc, org, legacy_code, match_type, confidence, status, created_at, reversed_at,
             reversal_reason)
    canonical(cnmc, short_code, description, category, subtype, unspsc, attributes, base_uom, status, version, value,
              created_at, updated_at)

    Approved pairs and active mappings form a graph; a component with two canonicals is a conflict and none of its
    approvals is applied.  A component without one joins an approved canonical of the same template code (unless a
    steward edited attributes), otherwise it founds one; components that arrive at the same new code share it.

    ``records`` is read several times and should be a written table.  The results are in the checkpoint folder, so the
    plans of successive batches do not stack."""
    when = F.lit(at).cast("timestamp")
    checked = cut_lineage(validate_decisions(decisions, recommendations))
    ends = recommendations.select("pair_key", "a_record_id", "b_record_id", "category", "match_type", "final_score")
    approved = cut_lineage(checked.filter("outcome = 'APPROVED'").join(ends, "pair_key"))
    active = mappings.filter("status = 'ACTIVE'").select("record_id", F.col("cnmc").alias("_code"))

    touched = approved.select(F.explode(F.array("a_record_id", "b_record_id")).alias("record_id")).distinct()
    anchors = touched.join(active, "record_id")
    edges = approved.select(F.concat(F.lit("r:"), "a_record_id").alias("a"), F.concat(F.lit("r:"), "b_record_id").alias("b"))
    edges = edges.unionByName(anchors.select(F.concat(F.lit("r:"), "record_id").alias("a"),
                                             F.concat(F.lit("z:"), "_code").alias("b")))
    comp = connected_components(edges)
    member = comp.filter(F.col("node").startswith("r:")).select(
        F.expr("substring(node, 3)").alias("record_id"), "component")
    owner = comp.filter(F.col("node").startswith("z:")).groupBy("component").agg(
        F.count("*").alias("n_owners"), F.min(F.expr("substring(node, 3)")).alias("owner"))

    # merged identity of components without a canonical
    pair_comp = approved.join(member.withColumnRenamed("record_id", "a_record_id"), "a_record_id")
    edits = pair_comp.groupBy("component").agg(
        F.min_by("edit_attributes", F.when(F.col("edit_attributes").isNotNull(), F.struct("decided_at", "pair_key")))
        .alias("edit_attributes"),
        F.min_by("edit_description", F.when(F.col("edit_description").isNotNull(), F.struct("decided_at", "pair_key")))
        .alias("edit_description"))
    facts = member.join(records.select("record_id", "category", "attributes", "base_uom"), "record_id")
    homeless = facts.join(owner, "component", "left_anti")
    profile = homeless.groupBy("component").agg(
        F.min("category").alias("category"), F.min_by("base_uom", F.when(
            F.col("base_uom").isNotNull(), F.col("record_id"))).alias("base_uom"))
    merged = profile.join(merge_group_attributes(homeless), "component").join(edits, "component", "left")
    merged = merged.withColumn("edited", F.col("edit_attributes").isNotNull()).withColumn(
        "attributes", F.when(F.col("edited"), override_attributes(
            F.col("attributes"), F.coalesce("edit_attributes", F.create_map().cast(MAP_TYPE)))).otherwise(
            F.col("attributes"))).withColumn("code", template_code(F.col("category"), F.col("attributes")))
    standing = canonical.filter("status = 'APPROVED'").select(F.col("cnmc").alias("code"), F.lit(True).alias("_hit"))
    merged = cut_lineage(merged.join(standing, "code", "left"))
    joins = merged.filter("_hit and not edited").select("component", F.col("code").alias("cnmc"))
    founding = merged.filter("_hit is null or edited")
    # components with the same unedited code share one new canonical, founded by the smallest component
    lead = founding.withColumn("_share", F.when(F.col("edited"), F.col("component")).otherwise(F.lit("")))
    founders = lead.groupBy("code", "_share").agg(
        F.min("component").alias("founder"),
        F.min_by(F.struct("category", "attributes", "base_uom", "edit_description"), "component").alias("f"))
    founders = unique_codes(founders.withColumnRenamed("founder", "component"), canonical.select("cnmc"))
    founders = cut_lineage(founders.select("component", "code", "_share", "cnmc", "f.*"))
    created_for = lead.select("component", "code", "_share").join(
        founders.select("code", "_share", "cnmc"), ["code", "_share"]).select("component", "cnmc")
    target = owner.filter("n_owners = 1").select("component", F.col("owner").alias("cnmc")).unionByName(joins).unionByName(
        created_for)
    conflict = owner.filter("n_owners > 1").select("component", F.lit(True).alias("_conflict"))

    new_canonical = _found(founders, canonical, when)
    resolved = cut_lineage(member.join(target, "component"))
    deciding = approved.select("pair_key", "match_type", "final_score", F.explode(
        F.array("a_record_id", "b_record_id")).alias("record_id")).groupBy("record_id").agg(
        F.min_by(F.struct("match_type", "final_score"), "pair_key").alias("d"))
    fresh = resolved.join(active, "record_id", "left_anti").join(deciding, "record_id").join(
        records.select("record_id", "org", "legacy_code"), "record_id").select(
        "record_id", "cnmc", "org", "legacy_code", F.col("d.match_type").alias("match_type"),
        F.col("d.final_score").alias("confidence"), F.lit("ACTIVE").alias("status"), when.alias("created_at"),
        F.lit(None).cast("timestamp").alias("reversed_at"), F.lit(None).cast("string").alias("reversal_reason"))
    mappings_after = cut_lineage(mappings.unionByName(fresh))

    retitled = pair_comp.filter("action = 'EDIT' and edit_description is not null").join(
        owner.filter("n_owners = 1"), "component").groupBy(F.col("owner").alias("cnmc")).agg(
        F.min_by("edit_description", F.struct("decided_at", "pair_key")).alias("_title"))
    canonical_after = canonical.join(retitled, "cnmc", "left").withColumns({
        "description": F.coalesce("_title", "description"),
        "version": F.col("version") + F.when(F.col("_title").isNotNull(), 1).otherwise(0),
        "updated_at": F.when(F.col("_title").isNotNull(), when).otherwise(F.col("updated_at")),
    }).drop("_title").unionByName(new_canonical)
    canonical_after = cut_lineage(
        refresh_values(canonical_after, mappings_after, records, resolved.select("cnmc").distinct(), when))

    outcomes = checked.join(ends.select("pair_key", "a_record_id"), "pair_key", "left").join(
        member.withColumnRenamed("record_id", "a_record_id"), "a_record_id", "left").join(
        conflict, "component", "left").join(target, "component", "left")
    clash = F.coalesce(F.col("_conflict") & (F.col("outcome") == "APPROVED"), F.lit(False))
    outcomes = outcomes.select(
        "pair_key", "action", "note", "decided_at",
        F.when(~clash, F.col("outcome")).alias("outcome"),
        F.when(clash, F.lit("Both records are already mapped to different canonical materials"))
        .otherwise(F.col("error")).alias("error"),
        F.when((F.col("outcome") == "APPROVED") & ~clash, F.col("cnmc")).alias("cnmc"))
    outcomes = cut_lineage(outcomes)
    recs_after = cut_lineage(close_recommendations(recommendations, outcomes, mappings_after, canonical_after))
    return Applied(outcomes, canonical_after, mappings_after, recs_after)


def _found(founders: DataFrame, canonical: DataFrame, when: Column) -> DataFrame:
    counts = canonical.groupBy("category").agg(F.count("*").alias("_have"))
    named = number_within(founders, "category", "cnmc", out="_n").join(F.broadcast(counts), "category", "left")
    prefix = by_family(F.col("category"), lambda s: F.lit(s.prefix), default=F.lit("GEN"))
    kind = by_family(F.col("category"), lambda s: value_text(F.col("attributes"), s.type_key))
    titled = F.coalesce("edit_description", canonical_description(F.col("category"), F.col("attributes")))
    rows = taxonomy(named.withColumn("subtype", kind))
    return rows.select(
        "cnmc", short_code(prefix, F.col("_n") + F.coalesce("_have", F.lit(0))).alias("short_code"),
        titled.alias("description"), "category", "subtype", "unspsc", "attributes", "base_uom",
        F.lit("APPROVED").alias("status"), F.lit(1).alias("version"), F.lit(0.0).alias("value"),
        when.alias("created_at"), when.alias("updated_at"))


def rolled_up_values(mappings: DataFrame, records: DataFrame) -> DataFrame:
    """G10 - sum of price x quantity over the active mappings of each canonical."""
    spend = records.select("record_id", (F.col("price") * F.col("qty")).alias("_spend"))
    return mappings.filter("status = 'ACTIVE'").join(spend, "record_id").groupBy("cnmc").agg(
        F.coalesce(F.sum("_spend"), F.lit(0.0)).alias("value"))


def refresh_values(canonical: DataFrame, mappings: DataFrame, records: DataFrame, touched: DataFrame,
                   when: Column) -> DataFrame:
    fresh = rolled_up_values(mappings, records).join(touched, "cnmc", "left_semi").withColumnRenamed("value", "_value")
    return canonical.join(fresh, "cnmc", "left").withColumns({
        "updated_at": F.when(F.col("_value").isNotNull(), when).otherwise(F.col("updated_at")),
        "value": F.coalesce("_value", "value")}).drop("_value")


def close_recommendations(recs: DataFrame, outcomes: DataFrame, mappings: DataFrame, canonical: DataFrame) -> DataFrame:
    """Status after a batch: decided pairs, transitively resolved ones (G11) and new proposals."""
    active = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc")
    titles = canonical.select("cnmc", "description")
    sided = lambda s: active.withColumnsRenamed({"record_id": f"{s}_record_id", "cnmc": f"_{s}"})
    d = outcomes.filter("outcome is not null").select(
        "pair_key", F.col("outcome").alias("_outcome"), F.col("note").alias("_note"), F.col("cnmc").alias("_cnmc"))
    r = recs.join(d, "pair_key", "left").join(sided("a"), "a_record_id", "left").join(sided("b"), "b_record_id", "left")
    is_open = F.col("status").isin(OPEN) & F.col("_outcome").isNull()
    resolved = is_open & F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    proposal = F.when(F.col("_outcome") == "APPROVED", F.col("_cnmc")).when(
        (F.col("status") == "PENDING") & F.col("_outcome").isNull() & ~resolved, F.coalesce("_a", "_b"))
    r = r.withColumn("_proposal", proposal).join(
        titles.withColumnsRenamed({"cnmc": "_proposal", "description": "_title"}), "_proposal", "left")
    return r.withColumns({
        "decision_note": F.when(resolved, F.concat(F.lit("Resolved transitively via "), F.col("_a"))).otherwise(
            F.coalesce("_note", "decision_note")),
        "status": F.when(resolved, F.lit("SUPERSEDED")).otherwise(F.coalesce("_outcome", "status")),
        "proposed_cnmc": F.coalesce("_proposal", "proposed_cnmc"),
        "proposed_description": F.when(F.col("_outcome").isNull(), F.coalesce("_title", "proposed_description"))
        .otherwise(F.col("proposed_description")),
    }).drop("_outcome", "_note", "_cnmc", "_a", "_b", "_proposal", "_title")


def reverse_mappings(requests: DataFrame, mappings: DataFrame, canonical: DataFrame, records: DataFrame,
                     at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G14 - requests(record_id, cnmc, reason) -> (outcomes, mappings, canonical).  The mapping row is kept."""
    when = F.lit(at).cast("timestamp")
    req = requests.groupBy("record_id", "cnmc").agg(F.min("reason").alias("reason"))
    state = mappings.groupBy("record_id", "cnmc").agg(F.count_if(F.col("status") == "ACTIVE").alias("_active"))
    outcomes = req.join(state, ["record_id", "cnmc"], "left").withColumn("error", F.when(
        F.length(F.trim(F.coalesce("reason", F.lit("")))) < 5, F.lit("A reversal reason is required"))
        .when(F.col("_active").isNull(), F.lit("Mapping not found"))
        .when(F.col("_active") == 0, F.lit("Mapping is already reversed"))).drop("_active")
    go = outcomes.filter("error is null").select("record_id", "cnmc", F.col("reason").alias("_reason"))
    hit = F.col("_reason").isNotNull() & (F.col("status") == "ACTIVE")
    after = mappings.join(go, ["record_id", "cnmc"], "left").withColumns({
        "reversed_at": F.when(hit, when).otherwise(F.col("reversed_at")),
        "reversal_reason": F.when(hit, F.col("_reason")).otherwise(F.col("reversal_reason")),
        "status": F.when(hit, F.lit("REVERSED")).otherwise(F.col("status"))}).drop("_reason")
    touched = go.select("cnmc").distinct()
    empty = touched.join(after.filter("status = 'ACTIVE'"), "cnmc", "left_anti").withColumn("_retire", F.lit(True))
    canon = canonical.join(empty, "cnmc", "left").withColumns({
        "status": F.when(F.col("_retire"), F.lit("RETIRED")).otherwise(F.col("status")),
        "updated_at": F.when(F.col("_retire"), when).otherwise(F.col("updated_at"))}).drop("_retire")
    return outcomes, after, refresh_values(canon, after, records, touched, when)


# ---------------------------------------------------------------------------------------------- masters over time
def revise_dictionary(entries: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G16 - type-2 history.  entries(term, category, expansion, kind, version, active); changes(term, category,
    expansion, kind, changed_at).  Returns (entries after, outcomes): a change equal to the entry it would follow is
    rejected, every other one becomes the next version and only the latest version stays active."""
    scope = lambda c: F.coalesce(F.col(c), F.lit(""))
    ch = changes.withColumns({"term": F.upper(F.trim("term")), "expansion": F.upper(F.trim("expansion")),
                              "_scope": scope("category")})
    base = entries.filter("active").select("term", scope("category").alias("_scope"),
                                           F.col("expansion").alias("_base"))
    last = entries.groupBy("term", scope("category").alias("_scope")).agg(F.max("version").alias("_v"))
    w = Window.partitionBy("term", "_scope").orderBy("changed_at", "expansion")
    staged = ch.join(base, ["term", "_scope"], "left").join(last, ["term", "_scope"], "left").withColumn(
        "_prev", F.coalesce(F.lag("expansion").over(w), F.col("_base")))
    staged = staged.withColumn("outcome", F.when(F.col("_prev") == F.col("expansion"), "REJECTED_IDENTICAL").when(
        F.col("_prev").isNull(), "ADDED").otherwise("REVISED"))
    new = staged.filter("outcome <> 'REJECTED_IDENTICAL'").withColumn(
        "version", (F.coalesce("_v", F.lit(0)) + F.row_number().over(w)).cast("int"))
    newest = Window.partitionBy("term", "_scope").orderBy(F.desc("version"))
    after = entries.withColumns({"_scope": scope("category"), "_was": F.col("active")}).select(
        "term", "category", "expansion", "kind", "version", "_scope", "_was").unionByName(
        new.select("term", "category", "expansion", "kind", "version", "_scope", F.lit(True).alias("_was")))
    after = after.withColumn("active", (F.row_number().over(newest) == 1) & F.col("_was")).drop("_scope", "_was")
    return after, staged.select("term", "category", "expansion", "outcome")


def current_rules(events: DataFrame) -> DataFrame:
    """G17 - substitution rules are appended and switched by flag events; the latest event of a rule decides."""
    w = Window.partitionBy("rule_id").orderBy(F.desc("changed_at"), F.desc("active"))
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def batch_status(events: DataFrame) -> DataFrame:
    """G18 - latest status of every ingestion batch from its append-only status events."""
    stage = F.array_position(F.array(*[F.lit(s) for s in ("INGESTED", "NORMALIZED", "CLASSIFIED", "MATCHED")]),
                             F.col("status"))
    return events.groupBy("batch_id").agg(
        F.max_by("status", F.struct("at", stage)).alias("status"), F.max("at").alias("at"))
