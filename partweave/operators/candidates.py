"""Candidate generation (J1-J4) without ever listing all record pairs of a group.

Three exact reductions come before any pair of records is formed:

* copies - records whose scoring inputs are equal are one *variant* with a multiplicity and a representative;
* profiles - variants whose attributes and units are equal share one *profile*; attribute comparison, vetoes and the
  group scores are computed once per profile pair, and a profile pair whose best reachable score cannot be stored is
  never expanded;
* tiles - a block with many profiles is cut into slices on both sides, so no task holds a hot block.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..masters import DEFAULT_CONFIG, SCHEMAS, SUBSTITUTION_RULES, EngineConfig
from .knn import knn_join
from .scoring import score_structure

SIDE_COLUMNS = ["record_id", "org", "category", "normalized", "attributes", "fingerprint", "missing_required",
                "base_uom", "uom_dimension", "manufacturer", "part_number", "price", "embedding", "block_key", "cnmc",
                "copies", "is_target"]
PROFILE_COLUMNS = ["category", "block_key", "attributes", "base_uom", "uom_dimension", "missing_required"]


def pair_key(a: Column, b: Column) -> Column:
    """Unordered identity of a pair."""
    return F.concat(F.least(a, b), F.lit("::"), F.greatest(a, b))


def _values_text(attributes: Column) -> Column:
    entries = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["value_text"])))
    return F.array_join(entries, "\u001f")


def with_keys(records: DataFrame) -> DataFrame:
    """Add profile_key (what attribute scoring reads) and variant_key (everything scoring reads)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    profile = F.sha2(F.concat_ws("\u001e", text("category"), text("block_key"), _values_text(F.col("attributes")),
                                 text("base_uom"), text("uom_dimension")), 256)
    out = records.withColumn("profile_key", profile)
    return out.withColumn("variant_key", F.sha2(F.concat_ws(
        "\u001e", F.col("profile_key"), text("org"), text("normalized"), text("manufacturer"), text("part_number"),
        text("price"), text("cnmc"), text("is_target")), 256))


def variants(records: DataFrame) -> DataFrame:
    """One row per distinct scoring input: representative = smallest record_id, ``copies`` = how many records share it.
    Pre-aggregated on the map side, so a group of copies of any size costs one row per partition."""
    keyed = with_keys(records)
    rest = [c for c in keyed.columns if c not in ("variant_key", "record_id", "copies")]
    return keyed.groupBy("variant_key").agg(
        F.min("record_id").alias("record_id"), F.count("*").alias("copies"),
        F.min_by(F.struct(*rest), "record_id").alias("_r")).select("variant_key", "record_id", "copies", "_r.*")


def copy_links(records: DataFrame) -> DataFrame:
    """(a_id, b_id): every copy is linked to its representative; together with the variant pairs this connects exactly
    the records that the full pair list would connect."""
    keyed = with_keys(records).select("variant_key", "record_id")
    reps = keyed.groupBy("variant_key").agg(F.min("record_id").alias("a_id"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(reps, "variant_key").filter(F.col("record_id") != F.col("a_id")).select(
        "a_id", F.col("record_id").alias("b_id"))


def tiled(df: DataFrame, key: str, id_col: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of an all-ordered-pairs join per key, cut into (key, i, j) tiles of at most ~tile x tile rows."""
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("_s"))
    cut = df.filter(F.col(key).isNotNull()).join(sizes, key).withColumn(
        "_slice", F.pmod(F.xxhash64(id_col), F.col("_s")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    left = cut.withColumn("_i", F.col("_slice")).withColumn("_j", every).drop("_s", "_slice")
    right = cut.withColumn("_j", F.col("_slice")).withColumn("_i", every).drop("_s", "_slice")
    return left, right


def blocking_pairs(keyed: DataFrame, id_col: str, block_col: str, content_cols: list[str] | None = None,
                   tile: int = 4000) -> DataFrame:
    """J1 on plain keys - (block, a_id, b_id, a_copies, b_copies) over distinct contents of each block; rows with equal
    content are one entry with a count, blocks are tiled, a NULL key is in no block."""
    content = content_cols or [id_col]
    reps = keyed.filter(F.col(block_col).isNotNull()).groupBy(block_col, *content).agg(
        F.min(id_col).alias("_id"), F.count("*").alias("_n")).select(F.col(block_col).alias("block"), "_id", "_n")
    left, right = tiled(reps, "block", "_id", tile)
    a = left.select("block", "_i", "_j", F.col("_id").alias("a_id"), F.col("_n").alias("a_copies"))
    b = right.select("block", "_i", "_j", F.col("_id").alias("b_id"), F.col("_n").alias("b_copies"))
    return a.join(b, ["block", "_i", "_j"]).filter("a_id < b_id").drop("_i", "_j")


def side(df: DataFrame, prefix: str, columns=SIDE_COLUMNS) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def storable(config: EngineConfig = DEFAULT_CONFIG) -> Column:
    """Whether a profile pair can still produce a pair that R1 keeps (uses the score ceiling, so nothing kept is lost)."""
    vetoed = F.size("vetoes") > 0
    missing = (F.size("a_missing_required") + F.size("b_missing_required")) > 0
    other_veto = F.exists("vetoes", lambda v: v["kind"] != "SIZE")
    return F.when(vetoed, other_veto & (F.col("score_ceiling") >= 0.72)).when(
        missing, F.lit(False)).otherwise(F.col("score_ceiling") >= 0.62)


def profile_pairs(vars_: DataFrame, config: EngineConfig = DEFAULT_CONFIG, schemas=SCHEMAS, rules=SUBSTITUTION_RULES,
                  tile: int = 500) -> DataFrame:
    """All ordered profile pairs of each block with their attribute verdict (one row per pair of vocabularies)."""
    profiles = vars_.filter(F.col("block_key").isNotNull()).groupBy("profile_key").agg(
        F.count("*").alias("n_variants"), F.max("is_target").alias("is_target"),
        F.min_by(F.struct(*PROFILE_COLUMNS), "record_id").alias("_p")).select(
        "profile_key", "n_variants", "is_target", "_p.*")
    left, right = tiled(profiles, "block_key", "profile_key", tile)
    cols = ["profile_key", "n_variants", "is_target", *PROFILE_COLUMNS]
    a = left.select("_i", "_j", F.col("block_key").alias("_block"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = right.select("_i", "_j", F.col("block_key").alias("_block"), *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, ["_block", "_i", "_j"]).filter("a_is_target or b_is_target").drop("_block", "_i", "_j")
    return score_structure(pairs, config, schemas, rules)


STRUCTURE = ["comparisons", "vetoes", "substitutions", "s_attribute", "s_specification", "s_dimension",
             "s_classification", "s_uom", "uom_reason", "_sub_a", "_sub_b", "score_ceiling", "score_floor"]


def expand_profiles(pairs: DataFrame, a_vars: DataFrame, b_vars: DataFrame, ordered: bool = True) -> DataFrame:
    """Profile pairs -> variant pairs.  Both joins are plain equi-joins on the profile, which AQE splits when one
    profile is hot.  The ordered form yields each unordered pair once, with the smaller id as side A."""
    keys = pairs.select("a_profile_key", "b_profile_key", *STRUCTURE)
    a = side(a_vars, "a", ["profile_key", *SIDE_COLUMNS])
    b = side(b_vars, "b", ["profile_key", *SIDE_COLUMNS])
    out = keys.join(a, "a_profile_key").join(b, "b_profile_key")
    out = out.filter("a_is_target or b_is_target")
    out = out.filter("a_record_id < b_record_id") if ordered else out.filter("a_record_id <> b_record_id")
    return out.drop("a_profile_key", "b_profile_key").withColumn(
        "pair_key", pair_key(F.col("a_record_id"), F.col("b_record_id")))


def knn_pairs(vars_: DataFrame, config: EngineConfig = DEFAULT_CONFIG, schemas=SCHEMAS,
              rules=SUBSTITUTION_RULES) -> DataFrame:
    """J2/J3 - pairs of a target with its k nearest neighbours of the same family, unordered and unique, outside their
    common block (pairs inside it are covered by the profiles), joined with both sides."""
    near = knn_join(vars_, "record_id", "category", "embedding", config.knn)
    targets = vars_.filter("is_target").select(F.col("record_id").alias("id"))
    keys = near.join(targets, "id", "left_semi").select(
        F.least("id", "neighbor_id").alias("a_record_id"),
        F.greatest("id", "neighbor_id").alias("b_record_id")).dropDuplicates(["a_record_id", "b_record_id"])
    out = keys.join(side(vars_, "a"), "a_record_id").join(side(vars_, "b"), "b_record_id")
    same_block = F.coalesce(F.col("a_block_key") == F.col("b_block_key"), F.lit(False))
    out = out.withColumn("same_block", same_block).withColumn(
        "pair_key", pair_key(F.col("a_record_id"), F.col("b_record_id")))
    return score_structure(out, config, schemas, rules)
