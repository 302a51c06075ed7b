"""Pair evaluation (M6-M15): fusion, classification, routing, reason codes and explanation.

Input is a joined pair DataFrame with every record column once as ``a_<col>`` and once as ``b_<col>``
(see ``candidates.with_sides``).  The whole evaluation is a chain of projections: no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp01, compact, half_up, let
from ..functions.similarity import (class_similarity, dot, fuse_semantic, jaro_winkler, levenshtein_ratio,
                                    price_similarity, sorted_tokens, token_jaccard)
from ..functions.text import alnum_key
from ..functions.uom import uom_compatibility
from ..masters import COMPONENTS, DEFAULT_CONFIG, SCHEMAS, SUBSTITUTION_RULES, EngineConfig
from .compare import apply_exclusions, compare_attributes, group_score
from .extract import by_family, value_text


def subtype(category: Column, attributes: Column, schemas=SCHEMAS) -> Column:
    return by_family(category, lambda s: value_text(attributes, s.type_key), schemas)


def deterministic_match(pn_a, make_a, pn_b, make_b, fp_a, fp_b) -> Column:
    """M6"""
    filled = lambda *cs: sum((F.when(F.length(F.coalesce(c, F.lit(""))) > 0, 0).otherwise(1) for c in cs), F.lit(0)) == 0
    same = filled(pn_a, pn_b, make_a, make_b) & (alnum_key(pn_a) == alnum_key(pn_b)) & (
        alnum_key(make_a) == alnum_key(make_b))
    return F.when(same, F.lit("MPN_EXACT")).when(fp_a == fp_b, F.lit("ATTRIBUTE_FINGERPRINT"))


def fuse(components: dict[str, Column], config: EngineConfig = DEFAULT_CONFIG) -> Column:
    """M7 - struct(score, weights); missing components give their weight away or count as zero."""
    renorm = config.missing_history == "renormalize"
    total = sum(
        (F.when(components[k].isNotNull(), F.lit(w)).otherwise(0.0) if renorm else F.lit(w)
         for k, w in config.weights.items()), F.lit(0.0))

    def spread(t: Column) -> Column:
        score = sum((F.coalesce(components[k], F.lit(0.0)) * (F.lit(w) / t) for k, w in config.weights.items()),
                    F.lit(0.0))
        effective = F.struct(*[
            (F.when(components[k].isNull(), 0.0).otherwise(half_up(F.lit(w) / t)) if renorm
             else half_up(F.lit(w) / t)).alias(k) for k, w in config.weights.items()])
        return F.struct(clamp01(score).alias("score"), effective.alias("weights"))

    return let(total, spread)


def classify_match(score: Column, vetoed: Column, insufficient: Column, deterministic: Column, text_identical: Column,
                   identity_differs: Column, config: EngineConfig = DEFAULT_CONFIG) -> Column:
    """M8"""
    c = config
    return (
        F.when(vetoed, "RELATED_BUT_NOT_EQUIVALENT")
        .when(insufficient, "INSUFFICIENT_DATA")
        .when(identity_differs & (score >= c.functional), "FUNCTIONALLY_EQUIVALENT")
        .when(identity_differs & (score >= c.related), "RELATED_BUT_NOT_EQUIVALENT")
        .when(identity_differs, "NOT_MATCHED")
        .when((score >= c.duplicate) & ((deterministic == "MPN_EXACT") | (deterministic.isNotNull() & text_identical)),
              "IDENTICAL")
        .when((score >= c.duplicate) & deterministic.isNotNull(), "DUPLICATE")
        .when(score >= c.near_duplicate, "NEAR_DUPLICATE")
        .when((score >= c.functional) & deterministic.isNotNull(), "NEAR_DUPLICATE")
        .when(score >= c.functional, "FUNCTIONALLY_EQUIVALENT")
        .when(score >= c.related, "RELATED_BUT_NOT_EQUIVALENT")
        .otherwise("NOT_MATCHED")
    )


def capped_score(raw: Column, vetoed: Column, config: EngineConfig = DEFAULT_CONFIG) -> Column:
    """M9"""
    return F.when(vetoed, half_up(F.least(raw, F.lit(config.functional - 0.01)))).otherwise(raw)


def route_match(match_type: Column, score: Column, config: EngineConfig = DEFAULT_CONFIG) -> Column:
    """M10"""
    return (
        F.when(match_type.isin("IDENTICAL", "DUPLICATE"),
               F.when(score >= config.auto_queue, "AUTO_QUEUE").otherwise("REVIEW"))
        .when(match_type.isin("NEAR_DUPLICATE", "FUNCTIONALLY_EQUIVALENT"),
              F.when(score >= config.review, "REVIEW").otherwise("UNRESOLVED"))
        .when(match_type == "INSUFFICIENT_DATA", "UNRESOLVED")
        .otherwise("NONE")
    )


def confidence_band(vetoed: Column, score: Column) -> Column:
    """M14"""
    return F.when(vetoed, "veto").when(score >= 0.95, "high").when(score >= 0.75, "amber").otherwise("neutral")


def reason_band(code: Column) -> Column:
    """M15 - review colour of one reason code."""
    return (
        F.when(code.startswith("VETO_"), "veto")
        .when(code.rlike("MATCH|EXACT|EQUIVALENT"), "high")
        .when(code.rlike("CONFLICT|DIFF|PARTIAL|SUBSTITUTABLE"), "amber")
        .otherwise("neutral")
    )


def _scored(c: Column) -> Column:
    return (c["weight"] > 0) & (c["status"] != "MISSING_BOTH")


def reason_codes(p: dict[str, Column]) -> Column:
    """M11 - ordered codes that explain a verdict."""
    sem = p["semantic"]

    def per_field(c: Column) -> Column:
        prefix = (F.when(c["status"] == "CONFLICT", "ATTR_CONFLICT:").when(c["status"] == "PARTIAL",
                                                                          "ATTR_UNDERSPECIFIED:")
                  .when(c["status"].isin("MISSING_A", "MISSING_B"), "ATTR_MISSING:")
                  .when(c["status"] == "SUBSTITUTABLE", "SUBSTITUTION_RULE_APPLIED:"))
        return F.when(c["weight"] > 0, F.concat(prefix, F.upper(c["key"])))

    none = F.lit(None).cast("string")
    return F.array_compact(F.concat(
        F.array(
            F.when(p["deterministic"] == "MPN_EXACT", "DETERMINISTIC_MPN_MATCH").when(
                p["deterministic"] == "ATTRIBUTE_FINGERPRINT", "ATTRIBUTE_FINGERPRINT_MATCH"),
            F.when(p["text_identical"], "TEXT_IDENTICAL_AFTER_NORMALIZATION"),
            F.when(sem >= 0.85, "SEMANTIC_HIGH").when(sem >= 0.6, "SEMANTIC_MODERATE").otherwise("SEMANTIC_LOW")),
        F.transform(p["vetoes"], lambda v: v["rule"]),
        F.transform(p["comparisons"], per_field),
        F.array(F.when(F.forall(F.filter(p["comparisons"], _scored), lambda c: c["status"] == "MATCH"),
                       "ATTRIBUTES_ALL_MATCH")),
        F.transform(F.array_union(p["missing_a"], p["missing_b"]),
                    lambda k: F.concat(F.lit("MISSING_REQUIRED:"), F.upper(k))),
        F.array(
            p["uom_reason"],
            F.when(p["procurement"].isNull(), "PROCUREMENT_HISTORY_UNAVAILABLE")
            .when(p["procurement"] >= 0.7, "PRICE_CONSISTENT").otherwise("PRICE_DIVERGENT"),
            F.when(p["org_a"] == p["org_b"], "SAME_CPSE_DUPLICATE").otherwise("CROSS_CPSE"),
            F.when(p["make_a"] != p["make_b"], "MANUFACTURER_DIFFERS").otherwise(none),
            F.when(F.exists(p["comparisons"], lambda c: c["status"].isin("CONFLICT", "SUBSTITUTABLE")),
                   "IDENTITY_OR_SPEC_DIFFERS")),
    ))


def explanation(p: dict[str, Column]) -> Column:
    """M12 - plain-language account of the verdict; absent sentences are NULL and skipped."""
    kept = lambda *statuses: F.filter(p["comparisons"], lambda c: _scored(c) & c["status"].isin(*statuses))
    shown = lambda c, side: F.concat(c[side], F.when(c["is_number"] & c["unit"].isNotNull(), F.concat(
        F.lit(" "), c["unit"])).otherwise(F.lit("")))
    versus = lambda rows: F.array_join(F.transform(rows, lambda c: F.concat(
        F.lower(c["label"]), F.lit(" ("), shown(c, "a"), F.lit(" vs "), shown(c, "b"), F.lit(")"))), ", ")
    nonempty = lambda rows, text: F.when(F.size(rows) > 0, text)
    words = lambda c: F.regexp_replace(F.lower(c), "_", " ")
    conflicts, partial = kept("CONFLICT", "VETO"), kept("PARTIAL", "SUBSTITUTABLE")
    missing, agree = kept("MISSING_A", "MISSING_B"), kept("MATCH")
    required = F.array_union(p["missing_a"], p["missing_b"])
    sem = p["semantic"]
    kind = F.coalesce(p["subtype_a"], p["subtype_b"])
    return F.concat_ws(
        " ",
        F.concat(F.lit("Both records are classified as "), words(p["category"]),
                 F.coalesce(F.concat(F.lit(" ("), words(kind), F.lit(")")), F.lit("")), F.lit("; "),
                 F.size(agree).cast("string"), F.lit(" of "),
                 F.size(F.filter(p["comparisons"], _scored)).cast("string"), F.lit(" compared attributes agree.")),
        nonempty(p["vetoes"], F.concat(F.lit("Hard exclusion: "), F.array_join(
            F.transform(p["vetoes"], lambda v: v["message"]), " "))),
        F.when(F.size(p["vetoes"]) == 0, nonempty(conflicts, F.concat(
            F.lit("They differ on "), versus(conflicts), F.lit(".")))),
        nonempty(p["substitutions"], F.concat(F.lit("An approved substitution rule applies: "),
                                              F.array_join(p["substitutions"], "; "), F.lit("."))),
        nonempty(partial, F.concat(F.lit("Partially compatible: "), versus(partial), F.lit("."))),
        nonempty(missing, F.concat(F.lit("Not stated on one side: "), F.array_join(
            F.transform(missing, lambda c: F.lower(c["label"])), ", "), F.lit("."))),
        nonempty(required, F.concat(F.lit("Required attributes missing ("), F.array_join(required, ", "), F.lit(
            ") — the source CPSE must enrich the record before equivalence can be confirmed."))),
        F.concat(F.lit("Description similarity after abbreviation expansion is "),
                 F.when(sem >= 0.85, "high").when(sem >= 0.6, "moderate").otherwise("low"), F.lit(" ("),
                 F.format_string("%.2f", sem), F.lit(").")),
        F.when(p["uom"] == 0, F.concat(
            F.lit("Units of measure are not convertible ("), F.coalesce(p["uom_a"], F.lit("?")), F.lit(" vs "),
            F.coalesce(p["uom_b"], F.lit("?")), F.lit("); a stocking-unit decision is needed."))),
        F.when(p["deterministic"] == "MPN_EXACT", F.concat(
            F.lit("Manufacturer part number is identical ("), p["maker"], F.lit(" "), p["part_number"], F.lit(").")))
        .when(p["deterministic"] == "ATTRIBUTE_FINGERPRINT",
              F.lit("All identity attributes produce the same fingerprint.")),
        F.concat(F.lit("Classified "), F.regexp_replace(p["match_type"], "_", " "), F.lit(" at "),
                 F.format_string("%.1f", p["final_score"] * 100), F.lit("% → "),
                 F.when(p["routing"] == "AUTO_QUEUE", "fast-track approval queue")
                 .when(p["routing"] == "REVIEW", "full steward review")
                 .when(p["routing"] == "UNRESOLVED", "unresolved queue").otherwise("no action (logged for audit)"),
                 F.lit(".")),
    )


def effective_make(manufacturer: Column, attributes: Column) -> Column:
    return F.coalesce(manufacturer, value_text(attributes, "manufacturer"))


def score_structure(pairs: DataFrame, config: EngineConfig = DEFAULT_CONFIG, schemas=SCHEMAS,
                    rules=SUBSTITUTION_RULES) -> DataFrame:
    """The part of a pair's verdict that depends on attributes and units only (no text, vectors or prices).

    Adds comparisons, vetoes, substitutions, the three group scores, classification and uom scores, and the highest
    fused score the pair can still reach when text and price agree perfectly (``score_ceiling``) and the lowest it can
    fall to when they do not agree at all (``score_floor``)."""
    category = F.col("a_category")
    out = (
        pairs.withColumn("_cmp", compare_attributes(category, F.col("a_attributes"), F.col("b_attributes"), schemas))
        .withColumn("_ex", apply_exclusions(category, F.col("_cmp"), rules, config.directional_substitution))
        .withColumns({"comparisons": F.col("_ex.comparisons"), "vetoes": F.col("_ex.vetoes"),
                      "substitutions": F.col("_ex.substitutions")})
        .withColumns({f"s_{g}": group_score(F.col("comparisons"), g)
                      for g in ("attribute", "specification", "dimension")})
        .withColumns({"_sub_a": subtype(category, F.col("a_attributes"), schemas),
                      "_sub_b": subtype(category, F.col("b_attributes"), schemas)})
        .withColumns({
            "s_classification": class_similarity(category, F.col("b_category"), F.col("_sub_a"), F.col("_sub_b")),
            "_uomc": uom_compatibility(F.col("a_base_uom"), F.col("a_uom_dimension"), F.col("b_base_uom"),
                                       F.col("b_uom_dimension")),
        })
        .withColumns({"s_uom": F.col("_uomc.score"), "uom_reason": F.col("_uomc.reason")})
    )
    ceiling = {k: F.lit(1.0) if k in ("semantic", "procurement") else F.col(f"s_{k}") for k in COMPONENTS}
    no_price = {**ceiling, "procurement": F.lit(None).cast("double")}
    floor = {k: F.lit(0.0) if k in ("semantic", "procurement") else F.col(f"s_{k}") for k in COMPONENTS}
    score = lambda parts: half_up(fuse(parts, config)["score"])
    return out.withColumns({
        "score_ceiling": F.greatest(score(ceiling), score(no_price)),
        "score_floor": F.least(score(floor), score({**floor, "procurement": F.lit(None).cast("double")})),
    }).drop("_cmp", "_ex", "_uomc")


def score_pairs(pairs: DataFrame, config: EngineConfig = DEFAULT_CONFIG, schemas=SCHEMAS,
                rules=SUBSTITUTION_RULES, structured: bool = False) -> DataFrame:
    """M13 - full evaluation of joined pairs.  Jaro-Winkler, the only Python step, runs last before the fusion and
    receives four short string columns."""
    p = pairs if structured else score_structure(pairs, config, schemas, rules)
    a_text, b_text = F.col("a_normalized"), F.col("b_normalized")
    words_a, words_b = F.split(a_text, " "), F.split(b_text, " ")
    p = (
        p.withColumns({
            "cosine": dot(F.col("a_embedding"), F.col("b_embedding")) / F.greatest(F.sqrt(
                dot(F.col("a_embedding"), F.col("a_embedding")) * dot(F.col("b_embedding"), F.col("b_embedding"))),
                F.lit(1e-300)),
            "levenshtein_ratio": levenshtein_ratio(a_text, b_text),
            "token_jaccard": token_jaccard(words_a, words_b),
        })
        .drop("a_embedding", "b_embedding")
        .withColumns({"_ja": sorted_tokens(words_a), "_jb": sorted_tokens(words_b)})
        .withColumns({"jaro_winkler": jaro_winkler(F.col("_ja"), F.col("_jb")),
                      "_jw_raw": jaro_winkler(a_text, b_text)})
        .drop("_ja", "_jb")
        .withColumn("s_semantic", fuse_semantic(F.col("cosine"), F.col("jaro_winkler"), F.col("levenshtein_ratio"),
                                                F.col("token_jaccard"), F.col("_jw_raw"), config))
        .withColumn("s_procurement", price_similarity(F.col("a_price"), F.col("b_price")))
        .withColumns({
            "_a_make": effective_make(F.col("a_manufacturer"), F.col("a_attributes")),
            "_b_make": effective_make(F.col("b_manufacturer"), F.col("b_attributes")),
        })
        .withColumn("deterministic", deterministic_match(
            F.col("a_part_number"), F.col("_a_make"), F.col("b_part_number"), F.col("_b_make"),
            F.col("a_fingerprint"), F.col("b_fingerprint")))
        .withColumn("_fused", fuse({k: F.col(f"s_{k}") for k in COMPONENTS}, config))
        .withColumns({"raw_score": half_up(F.col("_fused.score")), "weights": F.col("_fused.weights"),
                      "vetoed": F.size("vetoes") > 0, "text_identical": a_text == b_text})
        .withColumn("final_score", capped_score(F.col("raw_score"), F.col("vetoed"), config))
    )
    identity_differs = F.exists(
        "comparisons", lambda c: c["is_identity"] & c["status"].isin("CONFLICT", "SUBSTITUTABLE"))
    insufficient = (F.size("a_missing_required") + F.size("b_missing_required")) > 0
    p = p.withColumn("match_type", classify_match(
        F.col("raw_score"), F.col("vetoed"), insufficient, F.col("deterministic"), F.col("text_identical"),
        identity_differs, config)).withColumn("routing", route_match(F.col("match_type"), F.col("final_score"), config))
    rounded = {k: half_up(F.coalesce(F.col(f"s_{k}"), F.lit(0.0))) for k in COMPONENTS if k != "procurement"}
    rounded["procurement"] = half_up(F.col("s_procurement"))
    for k in ("cosine", "jaro_winkler", "levenshtein_ratio", "token_jaccard"):
        rounded[k] = half_up(F.col(k))
    p = p.withColumn("components", F.struct(*[c.alias(k) for k, c in rounded.items()]))
    view = {
        "semantic": F.col("components.semantic"), "uom": F.col("components.uom"),
        "procurement": F.col("components.procurement"), "deterministic": F.col("deterministic"),
        "text_identical": F.col("text_identical"), "vetoes": F.col("vetoes"), "comparisons": F.col("comparisons"),
        "substitutions": F.col("substitutions"), "missing_a": F.col("a_missing_required"),
        "missing_b": F.col("b_missing_required"), "uom_reason": F.col("uom_reason"), "org_a": F.col("a_org"),
        "org_b": F.col("b_org"), "make_a": value_text(F.col("a_attributes"), "manufacturer"),
        "make_b": value_text(F.col("b_attributes"), "manufacturer"), "category": F.col("a_category"),
        "subtype_a": F.col("_sub_a"), "subtype_b": F.col("_sub_b"), "uom_a": F.col("a_base_uom"),
        "uom_b": F.col("b_base_uom"), "maker": F.col("_a_make"), "part_number": F.col("a_part_number"),
        "match_type": F.col("match_type"), "final_score": F.col("final_score"), "routing": F.col("routing"),
    }
    return (
        p.withColumns({"reason_codes": reason_codes(view), "explanation": explanation(view)})
        .withColumn("category", F.col("a_category"))
        .drop("_fused", "_sub_a", "_sub_b", "_a_make", "_b_make", "_jw_raw", "score_ceiling", "score_floor",
              *[f"s_{k}" for k in COMPONENTS])
    )
