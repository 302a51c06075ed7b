"""Text normalisation: clean, expand, de-duplicate, tokenise, hash.  Pure Column programs, no Python per row."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import masters
from ..masters import DictionaryEntry
from .expr import let, lookup, matched, num_to_text, str_array, str_map

# Character classes of the lexical clean-up.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
DASHES = r"[\u2010\u2011\u2013\u2014]"
DOUBLE_QUOTES = r"''|[\u2033\u201D\u201C]"
SINGLE_QUOTES = r"[\u2019\u2018`']"
SEPARATORS = r"[,;:|()\[\]{}*_]+"
FRACTIONS = {"1/4": "0.25", "3/8": "0.375", "1/2": "0.5", "5/8": "0.625", "3/4": "0.75", "7/8": "0.875"}
HASH_SEPARATOR = "␟"


def trim_text(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column) -> Column:
    """T1 - upper-case and keep only punctuation that carries engineering meaning."""
    steps = [
        (DASHES, "-"),
        (DOUBLE_QUOTES, '"'),
        (SINGLE_QUOTES, " "),
        (SEPARATORS, " "),
        (rf"\.(?={SPACE}|$)", " "),
        (rf"{SPACE}*={SPACE}*", "="),
        (rf"{SPACE}+", " "),
    ]
    out = F.upper(F.coalesce(c, F.lit("")))
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


class CompiledDictionary:
    """T2 - one longest-first alternation and one literal map per (kind, category)."""

    def __init__(self, entries: Sequence[DictionaryEntry], kind: str, category: str | None):
        table: dict[str, str] = {}
        for e in entries:
            if e.kind != kind or e.category not in (None, category):
                continue
            term = e.term.upper()
            if term not in table or e.category is not None:
                table[term] = e.expansion
        self.table = table
        self.kind = kind
        terms = sorted(table, key=len, reverse=True)
        self.pattern = (
            "(?<![A-Z0-9])(" + "|".join(re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", t) for t in terms)
            + ")(?![A-Z0-9])" if terms else None
        )


def _run_pass(text: Column, d: CompiledDictionary) -> Column:
    """One left-to-right pass; struct(text, hits) where hits are the terms that were really replaced."""
    hit_type = "array<struct<term:string,expansion:string,kind:string>>"
    if d.pattern is None:
        return F.struct(text.alias("text"), F.array().cast(hit_type).alias("hits"))
    table = str_map(d.table)

    def replaced(t: Column) -> Column:
        def stitch(hits: Column) -> Column:
            gaps = F.split(t, d.pattern, -1)
            pieces = F.transform(
                gaps,
                lambda g, i: F.concat(g, F.coalesce(F.try_element_at(table, F.get(hits, i)), F.lit(""))),
            )
            changed = F.filter(hits, lambda h: F.element_at(table, h) != h)
            return F.struct(
                F.array_join(pieces, "").alias("text"),
                F.transform(
                    F.array_distinct(changed),
                    lambda h: F.struct(h.alias("term"), F.element_at(table, h).alias("expansion"),
                                       F.lit(d.kind).alias("kind")),
                ).alias("hits"),
            )

        return let(F.regexp_extract_all(t, F.lit(d.pattern), F.lit(1)), stitch)

    untouched = lambda t: F.struct(t.alias("text"), F.array().cast(hit_type).alias("hits"))
    return let(text, lambda t: F.when(t.rlike(d.pattern), replaced(t)).otherwise(untouched(t)))


def expand_text(cleaned: Column, dictionary: Sequence[DictionaryEntry] = None, category: str | None = None) -> Column:
    """T3 - abbreviations, then synonyms, never re-expanding inside a pass.  struct(text, expansions)."""
    dictionary = masters.DICTIONARY if dictionary is None else dictionary
    abbreviations = CompiledDictionary(dictionary, "ABBREVIATION", category)
    synonyms = CompiledDictionary(dictionary, "SYNONYM", category)

    def second(first: Column) -> Column:
        return let(
            _run_pass(first["text"], synonyms),
            lambda s: F.struct(
                F.trim(F.regexp_replace(s["text"], rf"{SPACE}+", " ")).alias("text"),
                F.concat(
                    first["hits"],
                    F.filter(s["hits"], lambda h: ~F.exists(first["hits"], lambda p: p["term"] == h["term"])),
                ).alias("expansions"),
            ),
        )

    return let(_run_pass(cleaned, abbreviations), second)


def dedupe_words(c: Column) -> Column:
    """T4 - drop repeated alphabetic words (3+ letters).  Linear: every other word is made unique by its position."""
    mark = "\u0001"
    keyed = F.transform(
        F.split(c, " "),
        lambda w, i: F.when(w.rlike("^[A-Z]{3,}$"), w).otherwise(F.concat(w, F.lit(mark), i.cast("string"))),
    )
    return F.regexp_replace(F.array_join(F.array_distinct(keyed), " "), mark + r"\d+", "")


def tokenize(c: Column) -> Column:
    """T5 - whitespace tokens without edge punctuation and stop words."""
    stop = str_array(masters.STOPWORDS)
    return F.filter(
        F.transform(F.split(c, rf"{SPACE}+"), lambda w: F.regexp_replace(w, r"^[-/.]+|[-/.]+$", "")),
        lambda w: (F.length(w) > 0) & ~F.array_contains(stop, w),
    )


def normalize_description(raw: Column, dictionary=None, category: str | None = None) -> Column:
    """T6 - struct(cleaned, normalized, tokens, expansions)."""
    return let(clean_text(raw), lambda c: normalize_cleaned(c, dictionary, category))


def normalize_cleaned(cleaned: Column, dictionary=None, category: str | None = None) -> Column:
    return let(
        expand_text(cleaned, dictionary, category),
        lambda e: let(
            dedupe_words(e["text"]),
            lambda n: F.struct(
                cleaned.alias("cleaned"), n.alias("normalized"), tokenize(n).alias("tokens"),
                e["expansions"].alias("expansions"),
            ),
        ),
    )


def semantic_tokens(c: Column) -> Column:
    """T8 - token bag for embeddings, without vendor names and procurement boiler-plate."""
    drop = str_array(masters.SEMANTIC_NOISE + masters.KNOWN_MAKES)
    return F.filter(
        F.transform(F.split(c, rf"(?:{SPACE}|[-/,])+"), lambda w: F.regexp_replace(w, r'^[."#]+|[."#]+$', "")),
        lambda w: (F.length(w) > 0) & ~F.array_contains(drop, w),
    )


def alnum_key(c: Column) -> Column:
    """T9"""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def row_hash(org: Column, *parts: Column) -> Column:
    """T10 - content hash of one extract row."""
    cells = [F.coalesce(trim_text(p), F.lit("")) for p in (org, *parts)]
    return F.sha2(F.concat_ws(HASH_SEPARATOR, *cells), 256)


def file_hash(row_hashes: Column) -> Column:
    """T11 - order-independent digest of all row hashes as an aggregate of constant size.

    ``row_hashes`` are hexadecimal digests.  Sums and xors of 60-bit parts of them are combined, so a file of any
    length is digested by partial aggregation with no row list gathered anywhere.  Duplicated rows still count (the
    sums and the row count change)."""
    part = lambda at: F.conv(F.substring(row_hashes, at, 15), 16, 10).cast("bigint")
    total = lambda at: F.sum(part(at).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count(row_hashes).cast("string"), total(1), total(16), total(31),
                              F.bit_xor(part(46)).cast("string")), 256)


def parse_inch(c: Column) -> Column:
    """T12 - '1-1/2', '1 1/2', '1/2', '1.5' -> inches."""

    def parsed(t: Column) -> Column:
        mixed, frac = r"^(\d+)[- ](\d+)/(\d+)$", r"^(\d+)/(\d+)$"
        g = lambda p, i: F.regexp_extract(t, p, i).cast("double")
        return (
            F.when(t.rlike(mixed), g(mixed, 1) + F.try_divide(g(mixed, 2), g(mixed, 3)))
            .when(t.rlike(frac), F.try_divide(g(frac, 1), g(frac, 2)))
            .when(t.rlike(r"^\d+(\.\d+)?$"), t.cast("double"))
        )

    return let(F.regexp_replace(F.trim(c), r"\s+", " "), parsed)


def code_segment(c: Column) -> Column:
    """T13 - inch fractions become decimals, everything outside [A-Z0-9.-] is dropped."""

    def render(t: Column) -> Column:
        whole = matched(t, r"(\d+)-(\d/\d)", 1).cast("double")
        part = F.coalesce(lookup(FRACTIONS, matched(t, r"(\d+)-(\d/\d)", 2)).cast("double"), F.lit(0.0))
        mixed = F.regexp_replace(t, F.lit(r"(\d+)-(\d/\d)"), num_to_text(whole + part))
        t2 = F.when(whole.isNotNull(), mixed).otherwise(t)
        for text, decimal in FRACTIONS.items():
            t2 = F.regexp_replace(t2, text, decimal)
        t2 = F.regexp_replace(t2, r"(\d)/(\d)", "$1.$2")
        return F.regexp_replace(t2, "[^A-Z0-9.-]", "")

    return let(F.upper(c), render)


def stable_json(json_text: Column) -> Column:
    """T15 - the same JSON with keys in order at every level (VARIANT objects keep their keys sorted)."""
    return F.to_json(F.parse_json(json_text))


def json_scalar(c: Column) -> Column:
    """JSON text of a string (quoted, escaped) or null."""
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(
        F.substring(wrapped, F.lit(6), F.length(wrapped) - F.lit(6))
    )
