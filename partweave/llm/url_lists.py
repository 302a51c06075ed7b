"""URL filters: dated list entries become validity intervals; every capture is judged as of its fetch time.
DataFrame functions only.

An entry event is (list_id, scope, key, action, at): scope ``domain`` covers a host and everything below it, scope
``path`` covers a host plus leading path segments.  ``add`` opens an interval that the next event of the same list,
scope and key closes; a second ``add`` without a ``remove`` between continues the interval; events of one instant
apply with ``remove`` last.  A capture is blocked if a ``block`` list is active for one of its keys when it was
fetched and no ``allow`` list is.

Defined results: a null, empty or unparsable URL has no keys and is allowed; a null fetch time is judged against no
entry; null event times, keys and actions are ignored; repeated captures are judged one by one; extra columns are
kept unless an output has their name; empty lists allow everything.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import boxed, cell, unboxed

FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def capture_keys(host: Column, path: Column) -> Column:
    """Every suffix of the host as a domain key and every prefix of the path as a path key."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(
        F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))).otherwise(
        F.expr("cast(array() as array<string>)"))
    return F.when(host == "", F.expr("cast(array() as array<string>)")).otherwise(F.concat(domains, paths))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(list_id, key, valid_from, valid_to): half-open intervals, one per run of ``add`` events.

    The window is per list and key, whose history is a handful of dated events however many captures it covers."""
    clean = events.filter(F.col("at").isNotNull() & F.col("key").isNotNull() & F.col("action").isin("add", "remove"))
    keyed = clean.select("list_id", F.concat(
        "scope", F.lit(":"), F.when(F.col("scope") == "domain", F.lower("key")).otherwise(F.col("key"))).alias("key"), "action", "at")
    order = W.partitionBy("list_id", "key").orderBy("at", "action")
    return (
        keyed.withColumn("_before", F.lag("action").over(order))
        .filter(F.col("_before").isNull() | (F.col("_before") != F.col("action")))
        .withColumn("valid_to", F.coalesce(F.lead("at").over(order), F.lit(FAR).cast("timestamp")))
        .filter((F.col("action") == "add") & (F.col("at") < F.col("valid_to")))
        .select("list_id", "key", F.col("at").alias("valid_from"), "valid_to")
    )


def url_verdicts(captures: DataFrame, events: DataFrame, lists: dict[str, str], capture_id="page_id", url="url",
                 fetched="fetched_at") -> DataFrame:
    """One row per capture: host, the active block and allow entries, and ``allowed``; a column of the captures with one
    of these names is replaced.

    ``lists`` maps list ids to ``block`` or ``allow``.  The as-of join is an equality join on the key with the fetch
    time inside the interval: intervals of one list and key never overlap, so each capture key meets at most one per
    list, and a hot host is split by the adaptive join because nothing gathers its captures."""
    role = F.lit(None).cast("string")
    for list_id, name in lists.items():
        role = F.when(F.col("list_id") == list_id, name).otherwise(role)
    spans = validity_intervals(events).withColumn("role", role)
    keys = capture_keys(F.col("_host"), F.col("_path"))
    placed = captures.select(
        F.col(capture_id).alias("_id"), F.col(fetched).alias("_at"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("_host"),
        F.coalesce(path_of(F.col(url)), F.lit("")).alias("_path")).select(
        "_id", "_at", F.explode(F.array_distinct(keys)).alias("key"))
    hits = (
        placed.join(spans, "key").filter((F.col("_at") >= F.col("valid_from")) & (F.col("_at") < F.col("valid_to")))
        .groupBy("_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("role") == "block", F.concat_ws("|", "list_id", "key")))).alias("blocked_by"),
            F.array_sort(F.collect_set(F.when(F.col("role") == "allow", F.concat_ws("|", "list_id", "key")))).alias("allowed_by"))
    )
    none = F.expr("cast(array() as array<string>)")
    blocked, allowed = [F.array_join(F.coalesce(c, none), ",") for c in ("blocked_by", "allowed_by")]
    return unboxed(
        boxed(captures).join(hits, cell(capture_id) == F.col("_id"), "left"), captures.columns,
        host=F.coalesce(host_of(cell(url)), F.lit("")), blocked_by=blocked, allowed_by=allowed,
        allowed=(blocked == "") | (allowed != ""))
