"""Quality rules: per-document rules plus cross-document line frequency.  DataFrame functions only.

A line is normalised (lower case, digits as 0, white space squeezed), hashed, and counted once per document and host.
A line that more documents of its host hold than both limits allow is boilerplate there and is removed; a document
that loses too large a part of its words is depleted and rejected.

Defined results: null text is the empty text (rejected, it has fewer than the required words); a null host is the
host ''; exact copies count as one document of their host, so that copies never make their own lines boilerplate
(``each_copy`` counts them one by one, as the SQL of op5 does); a repeated line counts once in its document; rows with
the same id are separate documents only if the id differs, so ids must be unique; extra columns are kept by
``quality_filter`` and never read; an empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, cell, let, materialise, unboxed

#: Fixed values of the contract.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def window_hashes(words: Column) -> Column:
    """The hash of every 3-word window; none for texts with one window or less, where nothing can repeat."""
    return F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
            F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.  O(n log n) inside the row, whatever repeats."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(ordered, lambda o: F.sort_array(F.transform(
        F.filter(o, lambda x, k: x["h"].eqNullSafe(F.get(o, k - 1)["h"]) | x["h"].eqNullSafe(F.get(o, k + 1)["h"])),
        lambda x: x["i"])))
    # Sorted starts: each one covers three words, less the overlap with the next.
    return let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda l: l.rlike(f"[^{SPACE}]"))


def _squeezed(line: Column) -> Column:
    """``line`` with single blanks between its words and none around them; single blanks are not matched one by one."""
    return F.trim(F.regexp_replace(line, f"[{SPACE}]{{2,}}|[\\x09-\\x0D]", " "))


def _digits_as_0(squeezed: Column) -> Column:
    return F.regexp_replace(F.lower(squeezed), "[1-9]", "0")


def normalised_line(line: Column) -> Column:
    return _digits_as_0(_squeezed(line))


def _line_words(squeezed: Column) -> Column:
    """Words of a squeezed line that is not blank: one more than its blanks."""
    return F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1


def base_rules(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    lines, windows, repeats = F.col("_lines"), F.col("_windows"), repeated_words(F.col("_windows"))
    n_words = F.size("_words").cast("long")
    # ``_again`` counts the windows that have occurred before.  At most twice as many windows occur more than once, and
    # each covers three words, so most documents pass without looking at which words these are.
    few = 6 * 100 * F.col("_again") <= MAX_REPEATED_PERCENT * n_words
    return (
        docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"))
        .select("doc_id", "_text", words_of(F.col("_text")).alias("_words"), _lines(F.col("_text")).alias("_lines"))
        .select("*", window_hashes(F.col("_words")).alias("_windows"))
        .select("*", (F.size(windows) - F.size(F.array_distinct(windows))).alias("_again"))
        .select(
            "doc_id",
            n_words.alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_again") == 0, F.lit(0).cast("long")).otherwise(repeats).alias("n_repeat_words"),
            ((n_words < MIN_WORDS) | F.when(few, F.lit(False)).otherwise(
                100 * repeats > MAX_REPEATED_PERCENT * n_words)).alias("base_failed"),
        )
    )


def _content(text) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_counts(docs: DataFrame, doc_id="doc_id", text="text", host="source") -> DataFrame:
    """(host, line, doc_id) -> words of that line in the document, repeats in the document summed, and its content."""
    body = F.coalesce(F.col(text), F.lit(""))
    per_line = F.transform(_lines(body), lambda l: let(_squeezed(l), lambda s: F.struct(
        F.xxhash64(_digits_as_0(s)).alias("line"), _line_words(s).cast("long").alias("words"))))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"),
                    _content(text).alias("content"), F.explode(per_line).alias("_l"))
        .groupBy("host", F.col("_l.line").alias("line"), "doc_id").agg(
            F.sum("_l.words").alias("words"), F.first("content").alias("content"))
    )


def boilerplate_lines(counts: DataFrame, docs: DataFrame, host="source", min_docs=20, max_share=0.1, text="text",
                      each_copy=False) -> DataFrame:
    """(host, line) held by more than ``min_docs`` documents of the host and more than ``max_share`` of them.

    Exact copies are one document here unless ``each_copy``.  Counts are aggregated before each shuffle; a line that a
    third of a host's documents hold is one row per task, and a group of copies one row per task and line."""
    of_host = F.coalesce(F.col(host), F.lit("")).alias("host")
    held = counts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs")).filter(
        F.col("line_docs") > min_docs)
    if each_copy:
        hosts = docs.groupBy(of_host).agg(F.count(F.lit(1)).alias("host_docs"))
    else:
        hosts = docs.select(of_host, _content(text).alias("content")).distinct().groupBy("host").agg(
            F.count(F.lit(1)).alias("host_docs"))
        # Contents are at most as many as documents: only lines that pass with all copies are counted again.
        held = counts.select("host", "line", "content").join(held.select("host", "line"), ["host", "line"], "left_semi").distinct().groupBy(
            "host", "line").agg(F.count(F.lit(1)).alias("line_docs")).filter(F.col("line_docs") > min_docs)
    return held.join(hosts, "host").filter(F.col("line_docs") > F.col("host_docs") * max_share).select(
        "host", "line", "line_docs")


def quality_verdicts(docs: DataFrame, doc_id="doc_id", text="text", host="source", min_docs=20, max_share=0.1,
                     min_left=0.5, each_copy=False) -> DataFrame:
    """One row per document: base measures, words lost to boilerplate lines, and the verdict ``kept``.

    ``kept``: the base rules pass and at least ``min_left`` of the words are outside boilerplate lines."""
    # Written, since three steps read it: the texts are cut into lines once.
    counts = materialise(line_counts(docs, doc_id, text, host))
    common = boilerplate_lines(counts, docs, host, min_docs, max_share, text, each_copy)
    lost = (
        counts.join(common, ["host", "line"])
        .groupBy("doc_id").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed_lines"))
    )
    lost_words = F.coalesce(F.col("n_removed_words"), F.lit(0))
    return (
        base_rules(docs, doc_id, text).join(lost, "doc_id", "left")
        .withColumn("n_removed_words", lost_words)
        .withColumn("kept", ~F.col("base_failed")
                    & (F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * min_left))
    )


def quality_filter(docs: DataFrame, doc_id="doc_id", text="text", host="source", min_docs=20, max_share=0.1,
                   min_left=0.5) -> DataFrame:
    """The documents that are kept, with their own columns, and without the boilerplate lines in their text.

    A text without such lines stays as it is, byte for byte."""
    # Written first: the optimiser would push the filter into the rules and evaluate them again inside it.  Only what
    # the filter needs is written, so measures that are no rule are not computed.
    verdicts = materialise(quality_verdicts(docs, doc_id, text, host, min_docs, max_share, min_left).select(
        "doc_id", "kept", "removed_lines"))
    kept = verdicts.filter("kept").select("doc_id", F.col("removed_lines").alias("gone")).hint("shuffle_hash")
    cleaned = F.array_join(F.filter(F.split(cell(text), "\n"), lambda l: ~F.array_contains(
        "gone", F.xxhash64(normalised_line(l))) | ~l.rlike(f"[^{SPACE}]")), "\n")
    return unboxed(boxed(docs).join(kept, cell(doc_id) == F.col("doc_id")), docs.columns, **{
        text: F.when(F.col("gone").isNull(), cell(text)).otherwise(cleaned)})
