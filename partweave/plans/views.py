"""User-level views: record grid and detail, review queue, lookup, canonical detail."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import contains_text, half_up
from ..functions.similarity import trigrams, trigram_similarity
from .dashboard import WAITING, pending_reviews


# ------------------------------------------------------------------------------------------------------- records
def record_grid(raw, norm, mappings, recs) -> DataFrame:
    """X1"""
    active = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc")
    grid = raw.join(norm, "record_id", "left").join(active, "record_id", "left").join(
        pending_reviews(recs).withColumnRenamed("n", "pending_reviews"), "record_id", "left")
    return grid.withColumn("pending_reviews", F.coalesce("pending_reviews", F.lit(0)))


def filter_grid(grid: DataFrame, batch: str | None = None, org: str | None = None, category: str | None = None,
                state: str | None = None) -> DataFrame:
    """P4 - state is mapped, unmapped, pending or insufficient."""
    states = {"mapped": F.col("cnmc").isNotNull(), "unmapped": F.col("cnmc").isNull(),
              "pending": F.col("pending_reviews") > 0, "insufficient": F.size("missing_required") > 0}
    out = grid
    for column, value in (("batch_id", batch), ("org", org), ("category", category)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.filter(states[state]) if state else out


def strip_internal(payload: Column) -> Column:
    """P7 - payload JSON without keys that begin with an underscore."""
    return F.to_json(F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: ~k.startswith("_")))


def record_detail(record_id: str, raw, norm, mappings, canonical, recs, top: int = 12) -> DataFrame:
    """X2 - one row: record, active mapping and its strongest recommendations as an array of at most ``top``."""
    mine = raw.filter(F.col("record_id") == record_id).withColumn("payload", strip_internal(F.col("payload")))
    touching = recs.filter((F.col("a_record_id") == record_id) | (F.col("b_record_id") == record_id))
    best = touching.orderBy(F.desc("final_score"), "pair_key").limit(top).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("final_score")).alias("order"), "pair_key", "match_type", "status", "vetoed"))).alias("recommendations"))
    active = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc").join(
        canonical.select("cnmc", F.col("description").alias("canonical_description")), "cnmc")
    return mine.join(norm, "record_id", "left").join(active, "record_id", "left").crossJoin(best)


def batch_list(batches: DataFrame) -> DataFrame:
    """X3/W3"""
    return batches.orderBy(F.desc("created_at"), "batch_id")


# -------------------------------------------------------------------------------------------------------- review
def both_sides(recs: DataFrame, raw: DataFrame) -> DataFrame:
    """K5 - code, description and organisation of both records of every pair."""
    sided = lambda s: raw.select(F.col("record_id").alias(f"{s}_record_id"), F.col("legacy_code").alias(f"{s}_code"),
                                 F.col("description").alias(f"{s}_description"), F.col("org").alias(f"{s}_org"))
    return recs.join(sided("a"), "a_record_id").join(sided("b"), "b_record_id")


def review_queue(tab: str, recs, raw, tasks) -> DataFrame:
    """X4 - the list behind one tab of the review screen (a top-n report: 600 open or 400 closed pairs).  The rows are
    chosen before the record columns are joined."""
    t = tasks.select("pair_key", "queue", "priority", F.col("status").alias("task_status"))
    joined = recs.join(t, "pair_key", "left")
    if tab == "VETOED":
        page, order = joined.filter("vetoed"), [F.desc("raw_score"), F.asc("pair_key")]
    elif tab == "DECIDED":
        page = joined.filter(F.col("status").isin("APPROVED", "REJECTED"))
        order = [F.desc("decided_at"), F.asc("pair_key")]
    else:
        page = joined.filter((F.col("queue") == tab) & F.col("task_status").isin(WAITING))
        order = [F.asc("priority"), F.desc("final_score"), F.asc("pair_key")]
    top = page.orderBy(*order).limit(400 if tab in ("VETOED", "DECIDED") else 600)
    return both_sides(top, raw).orderBy(*order)


def next_in_queue(queue: str, recs, tasks, after: str | None = None) -> DataFrame:
    """W5"""
    page = recs.join(tasks.filter((F.col("queue") == queue) & (F.col("status") == "OPEN")).select(
        "pair_key", "priority"), "pair_key")
    if after is not None:
        page = page.filter(F.col("pair_key") != after)
    return page.orderBy("priority", F.desc("final_score"), "pair_key").limit(1).select("pair_key")


def recommendation_detail(pair_key: str, recs, raw, mappings, ledger) -> DataFrame:
    """X5 - the pair with both records, members of the canonical it touches and its ledger history."""
    pair = both_sides(recs.filter(F.col("pair_key") == pair_key), raw)
    active = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc")
    owned = pair.select(F.explode(F.array("a_record_id", "b_record_id")).alias("record_id")).join(
        active, "record_id").agg(F.min("cnmc").alias("cnmc"))
    cluster = active.join(owned, "cnmc").join(raw.select("record_id", "org", "legacy_code"), "record_id").groupBy(
        "cnmc").agg(F.sort_array(F.collect_list(F.struct("org", "legacy_code"))).alias("cluster"))
    history = ledger.filter(F.col("entity_id") == pair_key).agg(
        F.sort_array(F.collect_list(F.struct("seq", "action"))).alias("history"))
    return pair.join(cluster, F.lit(True), "left").crossJoin(history)


# -------------------------------------------------------------------------------------------------------- lookup
def exact_lookup(term: str, raw, mappings, canonical, limit: int = 25) -> DataFrame:
    """X6 first half / P5 - code, CNMC or short code contains the term."""
    active = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc").join(
        canonical.select("cnmc", "short_code", F.col("description").alias("canonical_description")), "cnmc", "left")
    hit = contains_text(F.col("legacy_code"), term) | contains_text(F.col("cnmc"), term) | contains_text(
        F.col("short_code"), term)
    return raw.select("record_id", "org", "legacy_code", "description").join(active, "record_id", "left").filter(
        F.coalesce(hit, F.lit(False))).orderBy("org", "legacy_code", "record_id").limit(limit)


def trigram_index(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index rows (gram, id, n_grams); written once, it serves every lookup without scanning the texts."""
    g = texts.select(F.col(id_col), trigrams(F.col(text_col)).alias("_g"))
    return g.select(id_col, F.size("_g").alias("n_grams"), F.explode("_g").alias("gram"))


def trigram_search(requests: DataFrame, index: DataFrame, id_col: str, threshold: float = 0.3) -> DataFrame:
    """V10/K7 - requests(request_id, term) against an index: (request_id, id, sim) with sim >= threshold.

    An equi-join on the gram and one count per (request, text) replace the comparison of every request with every text;
    texts too short or too long to reach the threshold never meet the request (sim <= smaller / larger gram count);
    counting is partially aggregated before the shuffle, so a frequent gram costs no single task."""
    q = requests.select("request_id", trigrams(F.col("term")).alias("_g"))
    q = q.select("request_id", F.size("_g").alias("q_grams"), F.explode("_g").alias("gram"))
    fits = (q["gram"] == index["gram"]) & (F.col("n_grams") >= F.col("q_grams") * threshold) & (
        F.col("q_grams") >= F.col("n_grams") * threshold)
    shared = q.join(index, fits).groupBy("request_id", id_col).agg(
        F.count("*").alias("shared"), F.min("q_grams").alias("q"), F.min("n_grams").alias("n"))
    sim = F.col("shared") / (F.col("q") + F.col("n") - F.col("shared"))
    return shared.withColumn("sim", sim.cast("double")).filter(F.col("sim") >= threshold).select(
        "request_id", id_col, "sim")


def fuzzy_lookup(term: str, raw, norm, mappings, canonical, exact: DataFrame | None = None, limit: int = 25,
                 threshold: float = 0.3) -> DataFrame:
    """X6 second half - descriptions similar to the term, best first, without the exact hits.  One scan, no join
    between texts: the term is a constant, so similarity is a narrow projection before the top-n."""
    up = F.upper(F.lit(term))
    texts = raw.select("record_id", "org", "legacy_code", "description").join(
        norm.select("record_id", "normalized"), "record_id")
    scored = texts.withColumns({"_n": trigram_similarity(F.col("normalized"), up),
                                "_r": trigram_similarity(F.col("description"), up)})
    hits = scored.filter((F.col("_n") >= threshold) | contains_text(F.col("description"), term)).withColumn(
        "sim", half_up(F.greatest("_n", "_r"))).drop("_n", "_r")
    if exact is not None:
        hits = hits.join(exact.select("record_id"), "record_id", "left_anti")
    active = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc")
    return hits.orderBy(F.desc("sim"), "org", "legacy_code", "record_id").limit(limit).join(
        active, "record_id", "left").join(canonical.select(
            "cnmc", F.col("description").alias("canonical_description")), "cnmc", "left")


def lookup_codes(requests: DataFrame, raw, mappings, canonical) -> DataFrame:
    """X7 - batch form: requests(org, legacy_code) -> status, code and the other organisations' codes."""
    # Codes are joined before records and records before requests: a record without a code never meets a join on the code,
    # where all of them would be one key.
    active = mappings.filter("status = 'ACTIVE'").select("record_id", "cnmc", "match_type", "confidence").join(
        canonical.select("cnmc", "short_code", F.col("description").alias("canonical_description")), "cnmc", "left")
    known = raw.select("org", "legacy_code", "record_id").join(active, "record_id", "left")
    found = requests.withColumn("org", F.upper("org")).join(known, ["org", "legacy_code"], "left")
    members = mappings.filter("status = 'ACTIVE'").select(
        F.col("cnmc").alias("_c"), F.col("org").alias("_o"), F.col("legacy_code").alias("_l"))
    wanted = members.join(found.select(F.col("cnmc").alias("_c")).distinct(), "_c", "left_semi")
    siblings = found.select("org", "legacy_code", "cnmc").join(wanted, F.col("cnmc") == F.col("_c")).filter(
        ~((F.col("_o") == F.col("org")) & (F.col("_l") == F.col("legacy_code")))).groupBy("org", "legacy_code").agg(
        F.sort_array(F.collect_list(F.concat_ws(":", "_o", "_l"))).alias("siblings"))
    return found.join(siblings, ["org", "legacy_code"], "left").withColumns({
        "status": F.when(F.col("record_id").isNull(), "NOT_FOUND").when(
            F.col("cnmc").isNull(), "NOT_YET_HARMONISED").otherwise("HARMONISED"),
        "siblings": F.coalesce("siblings", F.array().cast("array<string>"))})


# ----------------------------------------------------------------------------------------------------- canonical
def find_canonical(key: str, canonical: DataFrame, id_col: str = "canonical_id") -> DataFrame:
    """P9 - by internal id (36 or 64 hex characters), code or short code."""
    is_id = F.lit(key).rlike("(?i)^([0-9a-f-]{36}|[0-9a-f]{64})$")
    return canonical.filter(F.when(is_id, F.col(id_col) == key).otherwise(
        (F.col("cnmc") == key) | (F.col("short_code") == key)))


def mapping_groups(mappings, raw, canonical) -> DataFrame:
    """Q20 - mappings per canonical as an ordered array."""
    rows = mappings.select("record_id", "cnmc", "org", "legacy_code", "match_type", "status").join(
        raw.select("record_id", "description"), "record_id")
    grouped = rows.groupBy("cnmc").agg(F.sort_array(F.collect_list(F.struct(
        "org", "legacy_code", "description", "match_type", "status"))).alias("mappings"))
    return canonical.select("cnmc", "description", "category", "status").join(grouped, "cnmc")


def canonical_detail(key: str, canonical, mappings, raw, ledger, id_col: str = "canonical_id") -> DataFrame:
    """X8 - one canonical with its mappings and the history of itself and its mappings."""
    one = find_canonical(key, canonical, id_col)
    groups = mapping_groups(mappings.join(one.select("cnmc"), "cnmc", "left_semi"), raw, one).select("cnmc", "mappings")
    ids = one.select(F.col("cnmc").alias("entity_id")).unionByName(mappings.join(
        one.select("cnmc"), "cnmc", "left_semi").select(F.col("record_id").alias("entity_id")))
    history = ledger.join(ids.distinct(), "entity_id", "left_semi").agg(
        F.sort_array(F.collect_list(F.struct("seq", "action"))).alias("history"))
    return one.join(groups, "cnmc", "left").crossJoin(history)


def last_run(runs: DataFrame, models: DataFrame) -> DataFrame:
    """X9"""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(1).join(models, "model_id")
