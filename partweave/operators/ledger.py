"""Hash-chained audit ledger (A1-A5)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import contains_text
from ..functions.text import json_scalar, stable_json

GENESIS = "0" * 64


def body_json(occurred_at: Column, actor_id: Column, actor: Column, role: Column, action: Column, entity_type: Column,
              entity_id: Column, reason: Column, payload: Column) -> Column:
    """Canonical JSON of an event: keys in order, UTC time with milliseconds, payload keys sorted at every level."""
    at = F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    parts = [("action", json_scalar(action)), ("actorId", json_scalar(actor_id)), ("actorName", json_scalar(actor)),
             ("actorRole", json_scalar(role)), ("entityId", json_scalar(entity_id)),
             ("entityType", json_scalar(entity_type)), ("occurredAt", json_scalar(at)),
             ("payload", F.coalesce(stable_json(payload), F.lit("{}"))), ("reason", json_scalar(reason))]
    cells = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts]
    return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))


def event_hash(prev: Column, body: Column) -> Column:
    """A1"""
    return F.sha2(F.concat(prev, F.lit("|"), body), 256)


def chain_events(events: DataFrame, seq: str = "seq", body: str = "body", segment_size: int = 1000,
                 ledger: str = "main") -> DataFrame:
    """A2 - add segment, prev_hash and hash.

    A hash chain is sequential by nature, so the ledger is cut into segments of consecutive sequence numbers.  Inside a
    segment the chain is folded in order (at most ``segment_size`` events, so the fold is bounded); every segment starts
    from its own seed, and ``seal_segments`` chains the segment heads.  All segments are folded in parallel."""
    segment = F.floor(F.col(seq) / F.lit(segment_size)).cast("bigint")
    seed = F.sha2(F.concat(F.lit(f"{GENESIS}|{ledger}|"), F.col("segment").cast("string")), 256)
    folded = events.withColumn("segment", segment).groupBy("segment").agg(
        F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(body).alias("body")))).alias("es"))
    link = lambda acc, e: F.concat(acc, F.array(F.struct(
        e["seq"].alias("seq"), F.element_at(acc, -1)["hash"].alias("prev_hash"),
        event_hash(F.element_at(acc, -1)["hash"], e["body"]).alias("hash"))))
    start = F.array(F.struct(F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("prev_hash"), seed.alias("hash")))
    chained = folded.select("segment", F.explode(F.slice(
        F.aggregate("es", start, link), F.lit(2), F.size("es"))).alias("c")).select(
        "segment", F.col("c.seq").alias(seq), "c.prev_hash", "c.hash")
    return events.join(chained, seq)


def segment_heads(ledger: DataFrame, seq: str = "seq") -> DataFrame:
    return ledger.groupBy("segment").agg(F.count("*").alias("events"), F.min(seq).alias("first_seq"),
                                         F.max(seq).alias("last_seq"), F.max_by("hash", seq).alias("head"))


def seal_segments(heads: DataFrame, fanout: int = 1000) -> DataFrame:
    """Chain the segment heads the same way, level by level, until one seal covers the whole ledger.  Each level is
    ``fanout`` times smaller, every fold is bounded by ``fanout``."""
    level = heads.select(F.col("segment").cast("bigint").alias("seq"), F.concat_ws(
        "|", F.col("segment").cast("string"), F.col("events").cast("string"), F.col("head")).alias("body"))
    depth = 0
    while True:
        depth += 1
        chained = chain_events(level, "seq", "body", fanout, f"level{depth}")
        tops = chained.groupBy("segment").agg(F.max_by("hash", "seq").alias("head"), F.sum(F.lit(1)).alias("events"))
        level = tops.select(F.col("segment").alias("seq"), F.col("head").alias("body"))
        if level.limit(2).count() < 2:
            return level.select(F.lit(depth).alias("levels"), F.col("body").alias("seal"))


def verify_chain(ledger: DataFrame, seq: str = "seq", body: str = "body", span: int = 1000,
                 genesis: str = GENESIS) -> DataFrame:
    """A3 - one row (ok, checked, broken_at_seq, head_hash, message) for a ledger chained from ``genesis``.

    An event is intact when its hash recomputes from its own prev_hash and body and its prev_hash is the hash of the
    event before it, so all events are checked in parallel.  The predecessor is found inside spans of consecutive
    sequence numbers; only the first event of a span looks at the last event of the nearest earlier span (one row per
    span), which keeps gaps in the numbering legal and every sort bounded."""
    d = ledger.select(F.col(seq).alias("seq"), F.col(body).alias("body"), "prev_hash", "hash").withColumn(
        "span", F.floor(F.col("seq") / F.lit(span)).cast("bigint"))
    inside = Window.partitionBy("span").orderBy("seq")
    d = d.withColumn("_before", F.lag("hash").over(inside))
    ends = d.groupBy("span").agg(F.max_by("hash", "seq").alias("_last"))
    coarse = F.floor(F.col("span") / F.lit(span))
    ends = ends.withColumn("_c", coarse)
    near = Window.partitionBy("_c").orderBy("span")
    tops = ends.groupBy("_c").agg(F.max_by("_last", "span").alias("_top"))
    tops = tops.withColumn("_far", F.lag("_top").over(Window.orderBy("_c"))).drop("_top")
    ends = ends.withColumn("_near", F.lag("_last").over(near)).join(F.broadcast(tops), "_c").select(
        "span", F.coalesce("_near", "_far", F.lit(genesis)).alias("_carry"))
    d = d.join(ends, "span")
    bad = (F.col("prev_hash") != F.coalesce("_before", "_carry")) | (
        F.col("hash") != event_hash(F.col("prev_hash"), F.col("body")))
    return _report(d.withColumn("_bad", F.coalesce(bad, F.lit(True))))


def verify_segments(ledger: DataFrame, seq: str = "seq", body: str = "body", segment_size: int = 1000,
                    ledger_name: str = "main") -> DataFrame:
    """A3 for a ledger written by ``chain_events``: every segment is checked from its own seed."""
    d = ledger.select(F.col(seq).alias("seq"), F.col(body).alias("body"), "prev_hash", "hash").withColumn(
        "segment", F.floor(F.col("seq") / F.lit(segment_size)).cast("bigint"))
    seed = F.sha2(F.concat(F.lit(f"{GENESIS}|{ledger_name}|"), F.col("segment").cast("string")), 256)
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("segment").orderBy("seq")), seed)
    bad = (F.col("prev_hash") != before) | (F.col("hash") != event_hash(F.col("prev_hash"), F.col("body")))
    return _report(d.withColumn("_bad", F.coalesce(bad, F.lit(True))))


def _report(d: DataFrame) -> DataFrame:
    r = d.agg(F.count("*").alias("checked"), F.min(F.when(F.col("_bad"), F.col("seq"))).alias("broken_at_seq"),
              F.max_by("hash", "seq").alias("head_hash"))
    ok = F.col("broken_at_seq").isNull()
    return r.select(ok.alias("ok"), "checked", "broken_at_seq", "head_hash", F.when(
        ok, F.concat(F.lit("All "), F.col("checked").cast("string"), F.lit(" events verified from genesis"))).otherwise(
        F.concat(F.lit("Chain broken at event #"), F.col("broken_at_seq").cast("string"))).alias("message"))


def search_ledger(ledger: DataFrame, text: str | None = None, action: str | None = None, before: int | None = None,
                  limit: int = 500) -> DataFrame:
    """A4/P5/P8 - newest first page of ``limit`` events below a sequence number."""
    d = ledger
    if text:
        d = d.filter(contains_text(F.concat_ws("\n", "actor", "reason", "payload", "entity_id"), text))
    if action:
        d = d.filter(F.col("action") == action)
    if before is not None:
        d = d.filter(F.col("seq") < before)
    return d.orderBy(F.desc("seq")).limit(limit)


def action_facets(ledger: DataFrame) -> DataFrame:
    """A4/Q15"""
    return ledger.groupBy("action").agg(F.count("*").alias("n"))


def entity_history(ledger: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """A5 - events of the given entities (entity_id) in ledger order."""
    return ledger.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").orderBy("seq")
