"""Record processing: normalise -> classify -> re-normalise with family terms -> extract -> units -> flags."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import masters
from ..functions.expr import blank_to_null, built_once, compact
from ..functions.text import clean_text, normalize_cleaned, semantic_tokens
from ..functions.uom import normalize_uom
from .classify import classify
from .describe import canonical_description
from .distinct import computed_once, with_computed
from .extract import (blocking_key, completeness, expected_dimension, extract_attributes, fingerprint,
                      missing_required)

STAGE1_FLAGS = r"^(UOM_|ABBREV|SHORT_TEXT)|_MISSING$"


def process_records(raw: DataFrame, dictionary=None, schemas=None, uom_master=None) -> DataFrame:
    """Add the normalised columns to raw records; a chain of narrow projections, no shuffle.

    Needs: description, long_text, uom, manufacturer, part_number.  Adds: cleaned, normalized, tokens, expansions,
    category, category_confidence, classifier_reasons, attributes, missing_required, completeness, fingerprint,
    block_key, uom_* and flags.  Every stage is one column that later stages read, so nothing is evaluated twice."""
    dictionary = masters.DICTIONARY if dictionary is None else dictionary
    schemas = schemas or masters.SCHEMAS
    uom_master = uom_master or masters.UOM_MASTER
    text = F.concat_ws(" ", blank_to_null(F.col("description")), blank_to_null(F.col("long_text")))
    key = (tuple(dictionary), tuple(schemas.values()), repr(uom_master))
    once = lambda name, make: built_once((key, name), make)
    scoped = sorted({d.category for d in dictionary if d.category})

    def renormalised() -> Column:
        out = F.when(F.lit(False), F.col("_generic"))
        for category in scoped:
            out = out.when(F.col("category") == category, normalize_cleaned(F.col("_cleaned"), dictionary, category))
        return out.otherwise(F.col("_generic"))

    category, attributes, missing = F.col("category"), F.col("attributes"), F.col("missing_required")
    has = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    flags = F.concat(
        F.col("_uom.flags"),
        compact(
            F.when(~has("manufacturer") & ~F.map_contains_key("attributes", "manufacturer"),
                   F.lit("MANUFACTURER_MISSING")),
            F.when(~has("part_number"), F.lit("PART_NUMBER_MISSING")),
            F.when(F.size("expansions") > 0,
                   F.concat(F.lit("ABBREVIATIONS_EXPANDED:"), F.size("expansions").cast("string"))),
            F.when(F.length("description") == 40, F.lit("SHORT_TEXT_TRUNCATED_40")),
            F.when(F.col("category") == masters.UNCLASSIFIED, F.lit("UNCLASSIFIED"))
            .when(F.col("category_confidence") < 0.7, F.lit("LOW_CLASSIFIER_CONFIDENCE")),
        ),
        F.transform(missing, lambda k: F.concat(F.lit("MISSING_REQUIRED:"), F.upper(k))),
    )
    return (
        raw.withColumn("_cleaned", clean_text(text))
        .withColumn("_generic", once("generic", lambda: normalize_cleaned(F.col("_cleaned"), dictionary)))
        .withColumn("_class", once("class", lambda: classify(F.col("_generic.normalized"))))
        .withColumns({"category": F.col("_class.category"), "category_confidence": F.col("_class.confidence"),
                      "classifier_reasons": F.col("_class.reasons")})
        .withColumn("_norm", once("norm", renormalised))
        .withColumns({n: F.col(f"_norm.{n}") for n in ("cleaned", "normalized", "tokens", "expansions")})
        .withColumn("_text", F.upper(F.concat(F.col("normalized"), F.lit(" ; "), F.col("cleaned"))))
        .withColumn("attributes", once("attributes", lambda: extract_attributes(
            F.col("category"), F.col("_text"), F.col("manufacturer"))))
        .withColumns({
            "missing_required": once("missing", lambda: missing_required(category, attributes, schemas)),
            "completeness": once("completeness", lambda: completeness(category, attributes, schemas)),
            "fingerprint": once("fingerprint", lambda: fingerprint(category, attributes, schemas)),
            "block_key": once("block", lambda: blocking_key(category, attributes, schemas)),
            "_uom": once("uom", lambda: normalize_uom(F.col("uom"), expected_dimension(category, schemas), uom_master)),
        })
        .withColumns({
            "uom_original": F.col("_uom.original"), "base_uom": F.col("_uom.code"),
            "uom_dimension": F.col("_uom.dimension"), "uom_factor": F.col("_uom.factor"),
        })
        .withColumn("flags", flags)
        .drop("_cleaned", "_generic", "_class", "_norm", "_uom", "_text")
    )


def process_distinct(raw: DataFrame, also: Callable[[DataFrame], DataFrame] = lambda df: df, **masters_) -> DataFrame:
    """The rows of ``process_records``, each combination of texts, unit and maker processed once (see ``distinct``).

    Of the part number only its presence counts.  ``also`` may add more columns that the processed ones decide."""
    given = F.when(F.length(F.trim(F.coalesce("part_number", F.lit("")))) > 0, F.lit("given"))
    values = ["description", "long_text", "uom", "manufacturer", "part_number"]
    found = computed_once(raw.withColumn("part_number", given), values, lambda df: also(process_records(df, **masters_)))
    return with_computed(raw, [*values[:-1], given], found)


def with_proposed_description(records: DataFrame) -> DataFrame:
    """E12 - template description for classified, complete records."""
    ready = (F.col("category") != masters.UNCLASSIFIED) & (F.size("missing_required") == 0)
    return records.withColumn("proposed_description", F.when(
        ready, canonical_description(F.col("category"), F.col("attributes"))))


def with_semantic_tokens(records: DataFrame) -> DataFrame:
    return records.withColumn("semantic_tokens", semantic_tokens(F.col("normalized")))


def normalize_stage(raw: DataFrame, **masters_) -> DataFrame:
    """Stage view before classification is published: category PENDING and only the early flags (P2 input)."""
    return (
        process_records(raw, **masters_)
        .withColumn("flags", F.filter("flags", lambda f: f.rlike(STAGE1_FLAGS)))
        .withColumn("category", F.lit(masters.PENDING))
        .withColumn("category_confidence", F.lit(0.0))
        .drop("attributes", "missing_required", "completeness", "fingerprint", "block_key", "classifier_reasons")
    )


def pending_for_normalize(raw: DataFrame, normalised: DataFrame, batch_id: str | None = None) -> DataFrame:
    """P2 - raw records without a normalised row."""
    rows = raw if batch_id is None else raw.filter(F.col("batch_id") == batch_id)
    return rows.join(normalised.select("record_id"), "record_id", "left_anti")


def pending_for_classify(raw: DataFrame, normalised: DataFrame, batch_id: str | None = None) -> DataFrame:
    """P2 - raw records whose normalised row is still PENDING."""
    rows = raw if batch_id is None else raw.filter(F.col("batch_id") == batch_id)
    waiting = normalised.filter(F.col("category") == masters.PENDING).select("record_id")
    return rows.join(waiting, "record_id", "left_semi")


def matchable(records: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """P3"""
    out = records.filter(~F.col("category").isin(masters.UNCLASSIFIED, masters.PENDING))
    return out if categories is None else out.filter(F.col("category").isin(categories))
