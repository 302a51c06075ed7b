"""The dictionary as of a time: every record is expanded by the entries that were valid when it was ingested.

A dictionary history is a table, however long, and meets the texts by a join: a text is cut into pieces (runs of letters
and digits, and single other characters), each piece looks up the terms that begin with it, and the longest term that
fits at a place wins.  Nothing is compiled into the plan, so its size does not depend on the dictionary.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE

PIECE = "[A-Z0-9]+|[^A-Z0-9]"
HITS = "array<struct<term:string,expansion:string,kind:string>>"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def validity(history: DataFrame) -> DataFrame:
    """(term, category, kind, expansion, valid_from, valid_to), half open, from history(term, category, kind, expansion,
    version, changed_at).

    An entry holds until the next one of its term, category and kind; a NULL expansion ends a term.  Of two entries of
    one instant the later version holds.  A NULL category covers every family."""
    order = Window.partitionBy("term", F.coalesce("category", F.lit("")), "kind").orderBy("changed_at", "version")
    rows = history.withColumn("term", F.upper(F.trim("term"))).filter(F.length("term") > 0)
    return rows.withColumn("valid_to", F.lead("changed_at").over(order)).filter(
        F.col("expansion").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("changed_at")))).select(
        "term", "category", "kind", "expansion", F.col("changed_at").alias("valid_from"), "valid_to")


def _matches(rows: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """(id, hits): the longest term of ``kind`` at every place of a text where one fits, in order of place."""
    terms = spans.filter(F.col("kind") == kind).withColumn("wanted", pieces(F.col("term"))).select(
        "term", "expansion", F.col("category").alias("scope"), "valid_from", "valid_to", "wanted", F.size("wanted").alias("n"),
        F.get("wanted", F.lit(0)).alias("first"))
    longest = terms.agg(F.max("n")).first()[0] or 0  # one number
    alnum = lambda c: F.coalesce(c.rlike("^[A-Z0-9]"), F.lit(False))
    starts = rows.select("id", "at", "category", pieces(F.col("text")).alias("p")).select(
        "id", "at", "category", F.explode(F.transform("p", lambda x, i: F.struct(
            (i + 1).alias("i"), x.alias("first"), alnum(F.get(F.col("p"), i - 1)).alias("joined"),
            F.slice(F.col("p"), i + 1, F.lit(longest + 1)).alias("window")))).alias("s")).select(
        "id", "at", "category", "s.*")
    fits = (
        (F.slice("window", F.lit(1), F.col("n")) == F.col("wanted"))
        & (alnum(F.col("first")) | ~F.col("joined"))
        & (alnum(F.element_at("wanted", -1)) | ~alnum(F.get("window", F.col("n"))))
        & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
        & (F.col("scope").isNull() | F.coalesce(F.col("scope") == F.col("category"), F.lit(False)))
    )
    best = starts.join(terms, "first").filter(fits).groupBy("id", "i").agg(F.max_by(
        F.struct("n", "term", "expansion"), F.struct("n", F.col("scope").isNotNull().alias("own"))).alias("m"))
    return best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "m.*"))).alias("hits"))


def _replaced(rows: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """One left-to-right pass: ``text`` with the terms replaced, ``done`` the terms that really changed it."""
    picked = F.aggregate(
        "hits", F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<struct<i:int,n:int,term:string,expansion:string>>)").alias("taken")),
        lambda s, h: F.when(h["i"] >= s["next"], F.struct(
            (h["i"] + h["n"]).alias("next"), F.array_append(s["taken"], h).alias("taken"))).otherwise(s),
        lambda s: s["taken"])
    found = rows.join(_matches(rows, spans, kind), "id", "left").withColumn("p", pieces(F.col("text"))).withColumn("hits", picked)
    end = lambda h: F.coalesce(h["i"] + h["n"], F.lit(1))
    parts = F.transform("hits", lambda h, k: F.concat(F.array_join(F.slice(
        F.col("p"), end(F.get(F.col("hits"), k - 1)), h["i"] - end(F.get(F.col("hits"), k - 1))), ""), h["expansion"]))
    rest = F.array_join(F.slice(F.col("p"), end(F.get("hits", F.size("hits") - 1)), F.size("p") + 1), "")
    changed = F.array_distinct(F.transform(F.filter("hits", lambda h: h["term"] != h["expansion"]), lambda h: F.struct(
        h["term"].alias("term"), h["expansion"].alias("expansion"), F.lit(kind).alias("kind"))))
    return found.withColumns({
        "text": F.when(F.size("hits") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text")),
        "done": F.coalesce(changed, F.array().cast(HITS))}).drop("hits", "p")


def expand_as_of(records: DataFrame, history: DataFrame, record_id="record_id", text="cleaned", at="ingested_at",
                 category="category") -> DataFrame:
    """(record_id, expanded, expansions): the text of each record with abbreviations, then synonyms, replaced by the
    entries valid at its time; inside a pass nothing is replaced twice.

    With one version of every entry this is ``functions.text.expand_text``.  A NULL text gives an empty one; a NULL time
    meets no entry; a NULL category meets the general entries alone.  Ids must be unique.  What is shuffled is the hits
    and each text once a pass; one number, the longest term, goes to the driver."""
    spans = validity(history)
    rows = records.select(F.col(record_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(at).alias("at"),
                          F.col(category).alias("category"))
    first = _replaced(rows, spans, "ABBREVIATION").withColumnRenamed("done", "one")
    both = _replaced(first, spans, "SYNONYM")
    fresh = F.filter("done", lambda h: ~F.exists("one", lambda p: p["term"] == h["term"]))
    return both.select(F.col("id").alias(record_id), F.trim(F.regexp_replace("text", rf"{SPACE}+", " ")).alias("expanded"),
                       F.concat("one", fresh).alias("expansions"))
