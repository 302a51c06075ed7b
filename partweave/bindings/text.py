"""Text, units, classifier, extraction and similarity (T*, U*, C*, E*, V*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import masters
from ..functions import similarity as V
from ..functions import text as T
from ..functions.expr import code_number, half_up, num_to_text
from ..functions.uom import iso_unit, normalize_uom, to_base_quantity, uom_compatibility
from ..operators import embed
from ..operators.classify import classify
from ..operators.describe import template_code
from ..operators.extract import explode_attributes, value_num, value_text
from ..operators.distinct import computed_once, with_computed
from ..operators.process import process_distinct, with_proposed_description
from ..plans import quality
from .base import Domain, oracle, query, table

# --------------------------------------------------------------------------------------------------- free text
SPACES = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def clean_sql(c: str) -> str:
    steps = [
        (r"[\x{2010}\x{2011}\x{2013}\x{2014}]", "-"), (r"''''|[\x{2033}\x{201D}\x{201C}]", '"'),
        (r"[\x{2019}\x{2018}`'']", " "), (r"[,;:|()\[\]{}*_]+", " "), (rf"\.({SPACES}|$)", r" \1"),
        (rf"{SPACES}*={SPACES}*", "="), (rf"{SPACES}+", " "),
    ]
    out = f"upper(replace({c}, 'ß', 'ss'))"
    for p, r in steps:
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return f"trim({out})"


@query("t1_clean_text", f"SELECT doc_id, sha256({clean_sql('text')}) AS cleaned, length({clean_sql('text')}) AS n FROM documents")
def t1(spark, d):
    c = T.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select(
        "doc_id", F.sha2("c", 256).alias("cleaned"), F.length("c").alias("n"))


@query("t4_dedupe_words", f"""SELECT doc_id, sha256(array_to_string(list_transform(list_filter(list_transform(w, lambda x, i:   CASE WHEN regexp_full_match(x, '[A-Z]{{3,}}') AND f[x] <> i THEN NULL ELSE x END), lambda x: x IS NOT NULL), lambda x: x), ' '))
  AS deduped FROM (SELECT doc_id, w, map_from_entries(list_transform(list_distinct(w), lambda x: {{'k': x, 'v': list_position(w, x)}}))
  AS f FROM (SELECT doc_id, string_split({clean_sql('text')}, ' ') AS w FROM documents))""")
def t4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("c")).select(
        "doc_id", F.sha2(T.dedupe_words(F.col("c")), 256).alias("deduped"))


STOP = "[" + ", ".join(f"'{w}'" for w in masters.STOPWORDS) + "]"


@query("t5_tokenize", f"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split({clean_sql('text')}, ' '),
  lambda x: regexp_replace(regexp_replace(x, '^[-/.]+', ''), '[-/.]+$', '')), lambda x: x <> '' AND NOT list_contains({STOP}, x)), ' '))
  AS tokens FROM documents""")
def t5(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("c")).select(
        "doc_id", F.sha2(F.array_join(T.tokenize(F.col("c")), " "), 256).alias("tokens"))


@query("t9_alnum_key", "SELECT url, regexp_replace(upper(url), '[^A-Z0-9]', '', 'g') AS k FROM pages")
def t9(spark, d):
    return table(spark, d, "pages").select("url", T.alnum_key(F.col("url")).alias("k"))


@query("t10_row_hash", oracle("""SELECT record_id, sha256(concat(org, '␟', legacy_code, '␟', description, '␟', '␟',
  coalesce(uom, ''), '␟', coalesce(manufacturer, ''), '␟', coalesce(part_number, ''))) AS row_hash FROM raw"""))
def t10(spark, d):
    c = F.col
    return Domain(spark, d).inputs().select("record_id", T.row_hash(c("org"), *[c(n) for n in (
        "legacy_code", "description", "long_text", "uom", "manufacturer", "part_number")]).alias("row_hash"))


def hex_part(at: int) -> str:
    return f"CAST('0x' || substr(h, {at}, 15) AS BIGINT)"


@query("t11_file_hash", f"""SELECT source, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum({hex_part(1)}) AS VARCHAR),
  CAST(sum({hex_part(16)}) AS VARCHAR), CAST(sum({hex_part(31)}) AS VARCHAR), CAST(bit_xor({hex_part(46)}) AS VARCHAR)))
  AS file_hash FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source""")
def t11(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(T.file_hash(F.sha2("text", 256)).alias("file_hash"))


DICT = "MAP {" + ", ".join(f"'{e.term}': '{e.expansion}'" for e in masters.DICTIONARY
                           if e.category is None and e.kind == "ABBREVIATION") + "}"
EXPAND = f"""expanded AS (SELECT record_id, replace(array_to_string(list_transform(string_split({clean_sql('description')}, ' '),
  lambda x: coalesce(dict[x], x)), ' '), 'PUMP SET', 'PUMP') AS t FROM raw, (SELECT {DICT} AS dict))"""


@query("t3_expand_dictionary", oracle("SELECT record_id, t AS expanded FROM expanded", EXPAND))
def t3(spark, d):
    return Domain(spark, d).raw.select("record_id", T.expand_text(T.clean_text(F.col("description")))["text"].alias(
        "expanded"))


@query("t3_expansion_counts", oracle("""SELECT term, count(*) AS n FROM (SELECT DISTINCT record_id, term FROM
  (SELECT record_id, unnest(string_split(c, ' ')) AS term FROM (SELECT record_id, """ + clean_sql("description") + """ AS c
  FROM raw)), (SELECT """ + DICT + """ AS dict) WHERE dict[term] IS NOT NULL AND dict[term] <> term
  UNION ALL SELECT record_id, 'PUMP SET' FROM raw WHERE description LIKE '%PUMP SET%') GROUP BY term"""))
def t3c(spark, d):
    e = T.expand_text(T.clean_text(F.col("description")))["expansions"]
    return Domain(spark, d).raw.select(F.explode(e).alias("e")).groupBy(F.col("e.term").alias("term")).agg(
        F.count("*").alias("n"))


@query("t6_normalize_description", oracle("""SELECT record_id, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN
  regexp_full_match(x, '[A-Z]{3,}') AND list_position(w, x) <> i THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' ')
  AS normalized FROM (SELECT record_id, string_split(t, ' ') AS w FROM expanded)""", EXPAND))
def t6(spark, d):
    return Domain(spark, d).raw.select("record_id", T.normalize_description(F.col("description"))["normalized"].alias(
        "normalized"))


DROP = "[" + ", ".join(f"'{w}'" for w in masters.SEMANTIC_NOISE + masters.KNOWN_MAKES) + "]"
SEM = f"""sem AS (SELECT record_id, list_filter(list_transform(regexp_split_to_array(t, '[ \\-/,]+'), x ->
  regexp_replace(regexp_replace(x, '^[."#]+', ''), '[."#]+$', '')), lambda x: x <> '' AND NOT list_contains({DROP}, x)) AS toks
  FROM expanded)"""


@query("t8_semantic_tokens", oracle("SELECT record_id, array_to_string(toks, ' ') AS tokens FROM sem", EXPAND, SEM))
def t8(spark, d):
    e = T.expand_text(T.clean_text(F.col("description")))["text"]
    return Domain(spark, d).raw.select("record_id", F.array_join(T.semantic_tokens(e), " ").alias("tokens"))


@query("t12_parse_inch", """SELECT p_partkey, p_size + (p_partkey % 7 + 1) / 8.0 AS mixed, (p_partkey % 7 + 1) / 8.0 AS frac,
  CAST(p_size AS DOUBLE) AS whole FROM part""")
def t12(spark, d):
    frac = F.concat(F.col("p_partkey") % 7 + 1, F.lit("/8"))
    return table(spark, d, "part").select(
        "p_partkey", T.parse_inch(F.concat("p_size", F.lit("-"), frac)).alias("mixed"), T.parse_inch(frac).alias("frac"),
        T.parse_inch(F.col("p_size").cast("string")).alias("whole"))


@query("t13_code_segment", "SELECT p_partkey, concat(p_size, '.5-11UNC', upper(replace(p_name, ' ', ''))) AS segment FROM part")
def t13(spark, d):
    return table(spark, d, "part").select("p_partkey", T.code_segment(F.concat(
        "p_size", F.lit("-1/2-11UNC "), "p_name")).alias("segment"))


@query("t14_number_text", """SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR)
  ELSE regexp_replace(printf('%.2f', c_acctbal), '0$', '') END AS balance FROM customer""")
def t14(spark, d):
    return table(spark, d, "customer").select("c_custkey", code_number(F.col("c_acctbal")).alias("balance"))


@query("t15_stable_json", """SELECT event_id, concat('{"a":', event_id, ',"props":{"k":', json_extract_string(props, '$.k'), '}}')
  AS j FROM events""")
def t15(spark, d):
    text = F.concat(F.lit('{"props": '), "props", F.lit(', "a": '), "event_id", F.lit("}"))
    return table(spark, d, "events").select("event_id", T.stable_json(text).alias("j"))


# -------------------------------------------------------------------------------------------------------- units
FACTS_UOM = """un AS (SELECT record_id, pk, rg, qty, family,
  CASE WHEN uom IS NULL OR uom = 'BOX' THEN NULL WHEN uom IN ('M', 'RM', 'MTR', 'MT') THEN 'M' WHEN uom = 'KM' THEN 'KM' ELSE 'EA'
  END AS code, CASE WHEN uom = 'KM' THEN 1000.0 ELSE 1.0 END AS factor,
  CASE WHEN uom IS NULL OR uom = 'BOX' THEN 'UNKNOWN' WHEN family = 'CABLE' THEN 'LENGTH' ELSE 'COUNT' END AS dim,
  CASE WHEN uom IS NULL THEN 'UOM_MISSING' WHEN uom = 'BOX' THEN 'UOM_UNRECOGNISED' WHEN uom = 'MT' THEN
  'UOM_AMBIGUOUS_MT,UOM_NONSTANDARD_ALIAS' WHEN uom IN ('RM', 'MTR', 'NOS', 'PCS', 'NO.') THEN 'UOM_NONSTANDARD_ALIAS' ELSE ''
  END AS flags FROM raw)"""


def _uom(x):
    from ..operators.extract import expected_dimension

    return x.raw.withColumn("u", normalize_uom(F.col("uom"), expected_dimension(F.col("family"))))


@query("u1_normalize_uom", oracle("SELECT record_id, code, dim, factor, flags FROM un", FACTS_UOM))
def u1(spark, d):
    return _uom(Domain(spark, d)).select("record_id", "u.code", F.col("u.dimension").alias("dim"), "u.factor",
                                         F.array_join("u.flags", ",").alias("flags"))


@query("u3_base_quantity", oracle("SELECT record_id, qty * factor AS base_qty FROM un", FACTS_UOM))
def u3(spark, d):
    return _uom(Domain(spark, d)).select("record_id", to_base_quantity(F.col("qty"), F.col("u")).alias("base_qty"))


@query("u4_uom_compatibility", oracle("""SELECT a.record_id AS a_id, CASE WHEN a.code IS NULL OR b.code IS NULL THEN 0.5
  WHEN a.code = b.code THEN 1.0 WHEN a.dim = b.dim THEN 0.9 ELSE 0.0 END AS score FROM un a JOIN un b ON a.pk = b.pk AND
  b.rg = a.rg + 1""", FACTS_UOM))
def u4(spark, d):
    u = _uom(Domain(spark, d)).select("record_id", "pk", "rg", "u")
    a, b = u.alias("a"), u.alias("b")
    c = F.col
    return a.join(b, (c("a.pk") == c("b.pk")) & (c("b.rg") == c("a.rg") + 1)).select(
        c("a.record_id").alias("a_id"), uom_compatibility(c("a.u.code"), c("a.u.dimension"), c("b.u.code"),
                                                          c("b.u.dimension"))["score"].alias("score"))


@query("u5_iso_unit", oracle("""SELECT record_id, CASE coalesce(code, '') WHEN 'M' THEN 'MTR' WHEN 'KM' THEN 'KMT' ELSE 'EA' END
  AS iso FROM un""", FACTS_UOM))
def u5(spark, d):
    return _uom(Domain(spark, d)).select("record_id", iso_unit(F.col("u.code")).alias("iso"))


# ------------------------------------------------------------------------------------- classifier and extraction
_PROCESSED: dict = {}


def _processed(spark, d):
    """The processed records of a directory, with template code and proposed description.  Each distinct record is processed
    and written once per session: filters of the queries stop at this boundary, and the rows are joined to it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PROCESSED:
        _PROCESSED[key] = process_distinct(Domain(spark, d).inputs(), lambda df: with_proposed_description(df).withColumn(
            "template_code", template_code(F.col("category"), F.col("attributes"))))
    return _PROCESSED[key]


@query("c1_classify", oracle("SELECT record_id, family AS category FROM raw"))
def c1(spark, d):
    """Each description is normalised and classified once."""
    raw = Domain(spark, d).raw.select("record_id", "description")
    found = computed_once(raw, ["description"], lambda df: df.withColumn("n", T.normalize_description(F.col("description"))[
        "normalized"]).select("description", classify(F.col("n"))["category"].alias("category")))
    return with_computed(raw, ["description"], found).select("record_id", "category")


# Fasteners score 4 for the noun and 1.5 each for thread and grade; the word HEAD (dialects 1 and 3) gives pumps 1.
@query("c5_confidence", oracle("""SELECT record_id, CASE WHEN family = 'UNCLASSIFIED' THEN 0.8 ELSE floor(least(0.99,
  0.55 + 0.35 * (7.0 - rival) / 7.0 + 0.02 * least(7.0, 5.0)) * 100 + 0.5) / 100 END AS confidence
  FROM (SELECT record_id, family, CASE WHEN noun = 'bolt' AND rg IN (1, 3) THEN 1.0 ELSE 0.0 END AS rival FROM raw)
  WHERE family IN ('UNCLASSIFIED', 'FASTENER')"""))
def c5(spark, d):
    raw = Domain(spark, d).raw.filter("family in ('UNCLASSIFIED', 'FASTENER')")
    return raw.select("record_id", classify(T.normalize_description(F.col("description"))["normalized"])[
        "confidence"].alias("confidence"))


def _attrs(spark, d, family: str, text: list[str], number: list[str]):
    p = _processed(spark, d)
    a = F.col("attributes")
    return p.filter(F.col("category") == family).select(
        "record_id", *[value_text(a, k).alias(k) for k in text], *[value_num(a, k).alias(k) for k in number])


@query("e1_bearing", oracle("""SELECT record_id, 'DEEP_GROOVE_BALL' AS bearing_type, desig AS designation, seal AS seal_type,
  clear AS clearance, CAST(bore AS DOUBLE) AS bore_mm, CAST(od AS DOUBLE) AS outer_diameter_mm, CAST(width AS DOUBLE) AS width_mm
  FROM raw WHERE family = 'BEARING'"""))
def e1(spark, d):
    return _attrs(spark, d, "BEARING", ["bearing_type", "designation", "seal_type", "clearance"],
                  ["bore_mm", "outer_diameter_mm", "width_mm"])


@query("e2_valve", oracle("""SELECT record_id, vtype AS valve_type, CASE WHEN lean = 1 THEN NULL ELSE cls END AS pressure_class,
  material AS body_material, 'FLANGED_RF' AS end_connection, CAST(dn AS DOUBLE) AS size_dn FROM raw WHERE family = 'VALVE'"""))
def e2(spark, d):
    return _attrs(spark, d, "VALVE", ["valve_type", "pressure_class", "body_material", "end_connection"], ["size_dn"])


@query("e3_cable", oracle("""SELECT record_id, 'POWER' AS cable_type, cond AS conductor, 'XLPE' AS insulation,
  CASE WHEN rg = 4 THEN 'WIRE' ELSE 'ARMOURED' END AS armour, CAST(cores AS DOUBLE) AS cores,
  CAST(sec AS DOUBLE) AS cross_section_sqmm, 1.1 AS voltage_grade_kv FROM raw WHERE family = 'CABLE'"""))
def e3(spark, d):
    return _attrs(spark, d, "CABLE", ["cable_type", "conductor", "insulation", "armour"],
                  ["cores", "cross_section_sqmm", "voltage_grade_kv"])


FAST = """fast AS (SELECT record_id, CASE noun WHEN 'bolt' THEN 'HEX_BOLT' ELSE 'STUD_BOLT' END AS fastener_type,
  concat('M', dia, 'X', CASE dia WHEN '16' THEN '2.0' ELSE pitch END) AS thread, concat('M', dia) AS thread_size,
  CASE noun WHEN 'bolt' THEN grade ELSE 'A193-B7' END AS grade, CASE WHEN noun = 'rod' THEN 'BLACK' WHEN finish = 'HDG' THEN 'HDG'
  WHEN finish = 'ZP' THEN 'ZINC_PLATED' ELSE 'BLACK' END AS finish, CAST(len AS DOUBLE) AS length_mm, pk, rg
  FROM raw WHERE family = 'FASTENER')"""


@query("e4_fastener", oracle("SELECT record_id, fastener_type, thread, thread_size, grade, finish, length_mm FROM fast", FAST))
def e4(spark, d):
    return _attrs(spark, d, "FASTENER", ["fastener_type", "thread", "thread_size", "grade", "finish"], ["length_mm"])


@query("e5_pump", oracle("""SELECT record_id, 'CENTRIFUGAL' AS pump_type, encl AS motor_enclosure, CAST(flow AS DOUBLE) AS flow_m3h,
  CAST(head AS DOUBLE) AS head_m, CAST(kw AS DOUBLE) AS motor_kw FROM raw WHERE family = 'PUMP'"""))
def e5(spark, d):
    return _attrs(spark, d, "PUMP", ["pump_type", "motor_enclosure"], ["flow_m3h", "head_m", "motor_kw"])


@query("e0_make", oracle("SELECT record_id, manufacturer AS make FROM raw WHERE family NOT IN ('UNCLASSIFIED', 'FASTENER', 'CABLE')"))
def e0(spark, d):
    p = _processed(spark, d).filter("category in ('BEARING', 'VALVE', 'PUMP')")
    return p.select("record_id", value_text(F.col("attributes"), "manufacturer").alias("make"))


@query("e7_missing_required", oracle("""SELECT record_id, CASE WHEN family = 'VALVE' AND lean = 1 THEN 'pressure_class' ELSE '' END
  AS missing FROM raw"""))
def e7(spark, d):
    return _processed(spark, d).select("record_id", F.array_join("missing_required", ",").alias("missing"))


@query("e8_completeness", oracle("""SELECT record_id, CASE family WHEN 'BEARING' THEN 0.95 WHEN 'CABLE' THEN 0.86 WHEN 'PUMP' THEN
  floor(13.0 / 16 * 100 + 0.5) / 100
  WHEN 'FASTENER' THEN 0.96 WHEN 'VALVE' THEN CASE WHEN lean = 1 THEN 0.58 ELSE 0.74 END ELSE 0.0 END AS completeness FROM raw"""))
def e8(spark, d):
    return _processed(spark, d).select("record_id", "completeness")


@query("e9_fingerprint", oracle("""SELECT record_id, concat('FASTENER|fastener_type=', fastener_type, '|finish=', finish, '|thread=',
  thread, '|grade=', grade, '|length_mm=', CAST(CAST(length_mm AS INT) AS VARCHAR)) AS fingerprint FROM fast""", FAST))
def e9(spark, d):
    return _processed(spark, d).filter("category = 'FASTENER'").select("record_id", "fingerprint")


@query("e10_quality_flags", oracle("""SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM un
  WHERE flags <> '' UNION ALL SELECT 'MANUFACTURER_MISSING' FROM raw WHERE rg >= 2
  UNION ALL SELECT 'PART_NUMBER_MISSING' FROM raw WHERE rg >= 2 UNION ALL SELECT 'UNCLASSIFIED' FROM raw WHERE family =
  'UNCLASSIFIED' UNION ALL SELECT 'MISSING_REQUIRED' FROM raw WHERE family = 'VALVE' AND lean = 1
  UNION ALL SELECT 'SHORT_TEXT_TRUNCATED_40' FROM raw WHERE length(description) = 40) GROUP BY flag""", FACTS_UOM))
def e10(spark, d):
    from ..plans.dashboard import flag_histogram

    return flag_histogram(_processed(spark, d)).filter("flag <> 'ABBREVIATIONS_EXPANDED'")


@query("e11_attribute_rows", oracle("""SELECT category, key, count(*) AS n FROM (
  SELECT family AS category, unnest(CASE family WHEN 'BEARING' THEN ['bearing_type', 'designation', 'seal_type', 'clearance',
  'bore_mm', 'outer_diameter_mm', 'width_mm'] WHEN 'VALVE' THEN ['valve_type', 'body_material', 'end_connection', 'size_dn'] WHEN
  'CABLE' THEN ['cable_type', 'conductor', 'insulation', 'armour', 'cores', 'cross_section_sqmm', 'voltage_grade_kv'] WHEN
  'FASTENER' THEN ['fastener_type', 'thread', 'thread_size', 'grade', 'finish', 'length_mm'] WHEN 'PUMP' THEN ['pump_type',
  'motor_enclosure', 'flow_m3h', 'head_m', 'motor_kw'] ELSE [] END) AS key FROM raw
  UNION ALL SELECT 'VALVE', 'pressure_class' FROM raw WHERE family = 'VALVE' AND lean = 0
  UNION ALL SELECT family, 'manufacturer' FROM raw WHERE rg < 2 AND family IN ('BEARING', 'VALVE', 'CABLE', 'PUMP')) GROUP BY
  category, key"""))
def e11(spark, d):
    p = _processed(spark, d).select("record_id", "category", "attributes")
    return p.select("category", F.explode(F.map_keys("attributes")).alias("key")).groupBy("category", "key").agg(
        F.count("*").alias("n"))


@query("g3_template_code", oracle("""SELECT record_id, CASE family
  WHEN 'BEARING' THEN concat('IN-MAT-BRG-DGBB-', desig, CASE WHEN seal = 'OPEN' THEN '' ELSE concat('-', seal) END, '-', clear, '-',
    bore, 'X', od, 'X', width)
  WHEN 'VALVE' THEN concat('IN-MAT-VLV-', vtype, '-DN', dn, '-CL', CASE WHEN lean = 1 THEN 'NA' ELSE cls END, '-', material, '-RF')
  WHEN 'CABLE' THEN concat('IN-MAT-CBL-PWR-1.1KV-', cores, 'CX', sec, '-', cond, '-XLPE-', CASE WHEN rg = 4 THEN 'SWA' ELSE 'ARM' END)
  WHEN 'FASTENER' THEN concat('IN-MAT-FST-', CASE noun WHEN 'bolt' THEN 'HXBOLT' ELSE 'STUD' END, '-M', dia, 'X', pitch, 'X', len, '-',
    CASE noun WHEN 'bolt' THEN grade ELSE 'A193-B7' END, '-', CASE WHEN noun = 'rod' THEN 'BLK' ELSE finish END)
  WHEN 'PUMP' THEN concat('IN-MAT-PMP-CENT-', flow, 'M3H-', head, 'M-', kw, 'KW', CASE WHEN encl = 'FLP' THEN '-FLP' ELSE '' END) END
  AS code FROM raw"""))
def g3(spark, d):
    return _processed(spark, d).select("record_id", F.col("template_code").alias("code"))


@query("e12_proposed_description", oracle("""SELECT record_id, CASE family
  WHEN 'BEARING' THEN concat('BEARING, BALL, DEEP GROOVE, ', desig, CASE seal WHEN '2RS' THEN ', DOUBLE SEALED 2RS' WHEN 'ZZ' THEN
    ', DOUBLE SHIELDED ZZ' ELSE ', OPEN' END, ', ', clear, ' CLEARANCE, ', bore, 'X', od, 'X', width, 'MM')
  WHEN 'FASTENER' THEN concat(CASE noun WHEN 'bolt' THEN 'BOLT, HEX HEAD' ELSE 'STUD BOLT' END, ', M', dia, 'X', pitch, ' X ', len,
    'MM, GRADE ', CASE noun WHEN 'bolt' THEN grade ELSE 'A193-B7' END, ', ', CASE WHEN noun = 'rod' OR finish = 'BLK' THEN 'BLACK'
    WHEN finish = 'HDG' THEN 'HDG' ELSE 'ZINC PLATED' END)
  WHEN 'CABLE' THEN concat('CABLE, POWER, 1.1KV, ', cores, 'C X ', sec, ' SQMM, ', condword, ', XLPE, ', CASE WHEN rg = 4 THEN
    'STEEL WIRE ARMOURED' ELSE 'ARMOURED' END)
  WHEN 'PUMP' THEN concat('PUMP, CENTRIFUGAL, ', flow, ' M3/H @ ', head, ' M HEAD, ', kw, ' KW, ', CASE encl WHEN 'FLP' THEN
    'FLAMEPROOF MOTOR' ELSE 'TEFC MOTOR' END)
  WHEN 'VALVE' THEN CASE WHEN lean = 0 THEN concat('VALVE, ', vtype, ', ', inch, 'IN (DN', dn, '), CLASS ', cls, ', ', CASE material
    WHEN 'CS-WCB' THEN 'ASTM A216 WCB' WHEN 'CS-WCC' THEN 'ASTM A216 WCC' WHEN 'CS-A105' THEN 'ASTM A105' ELSE 'SS316 (CF8M)' END,
    ', FLANGED RF') END END AS description FROM raw"""))
def e12(spark, d):
    return _processed(spark, d).select("record_id", F.col("proposed_description").alias("description"))


@query("p3_matchable", oracle("SELECT record_id FROM raw WHERE family <> 'UNCLASSIFIED'"))
def p3(spark, d):
    from ..operators.process import matchable

    return matchable(_processed(spark, d)).select("record_id")


@query("q13_extract_preview", oracle("""SELECT count(*) AS rows, count(*) AS valid, 0 AS missing_legacy_code,
  0 AS missing_description, count(*) FILTER (WHERE uom IS NULL) AS missing_uom,
  count(*) FILTER (WHERE manufacturer IS NULL) AS missing_manufacturer,
  count(*) FILTER (WHERE part_number IS NULL) AS missing_part_number,
  count(*) - count(DISTINCT split_part(legacy_code, '-', 1)) AS in_file_duplicates FROM raw"""))
def q13(spark, d):
    rows = Domain(spark, d).inputs().withColumn("legacy_code", F.split_part("legacy_code", F.lit("-"), F.lit(1)))
    return quality.missing_counts(rows)


@query("q13_uom_issues", oracle("""SELECT coalesce(r.uom, '∅') AS raw_uom, flag, count(*) AS n, min(code) AS normalized_to FROM raw r
  JOIN (SELECT record_id, code, unnest(string_split(flags, ',')) AS flag FROM un WHERE flags <> '') u ON u.record_id = r.record_id
  GROUP BY 1, 2""", FACTS_UOM))
def q13u(spark, d):
    u = _uom(Domain(spark, d)).select("uom", F.col("u.code").alias("base_uom"), F.col("u.flags").alias("flags"))
    return quality.uom_issue_counts(u)


@query("q14_stage_metrics", oracle("""SELECT count(*) AS normalized, (SELECT count(*) FROM un WHERE flags <> '') AS uom_issues,
  count(*) FILTER (WHERE family = 'VALVE' AND lean = 1) AS insufficient FROM raw""", FACTS_UOM))
def q14(spark, d):
    from ..plans.dashboard import stage_metrics

    return stage_metrics(_processed(spark, d)).select("normalized", "uom_issues", "insufficient")


# --------------------------------------------------------------------------------------------------- similarity
PAIR = """pr AS (SELECT x.pair_key, a.description AS a, b.description AS b, a.price AS pa, b.price AS pb, a.family AS fa,
  b.family AS fb FROM recs x JOIN raw a ON a.record_id = x.a_record_id JOIN raw b ON b.record_id = x.b_record_id)"""


def _pairs(spark, d):
    x = Domain(spark, d)
    side = lambda s: x.raw.select(F.col("record_id").alias(f"{s}_record_id"), F.col("description").alias(s),
                                  F.col("price").alias(f"p{s}"), F.col("family").alias(f"f{s}"))
    return x.recs.select("pair_key", "a_record_id", "b_record_id").join(side("a"), "a_record_id").join(
        side("b"), "b_record_id")


@query("v1_fnv_hash", """SELECT s_suppkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(
  s_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) AS h FROM supplier""")
def v1(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", embed.fnv1a32(F.col("s_name")).alias("h"))


def fnv(c: str) -> str:
    return (f"CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({c}, ''), lambda c: CAST(ascii(c) "
            f"AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT)")


@query("v2_embedding", f"""WITH t AS (SELECT p_partkey, string_split(upper(concat(p_name, ' ', p_type, ' ', p_size)), ' ') AS toks
  FROM part), w AS (SELECT p_partkey, unnest(list_distinct(toks)) AS w FROM t),
  f AS (SELECT p_partkey, concat('w:', w) AS feat, CASE WHEN regexp_matches(w, '[0-9]') THEN 1.3 ELSE 1.0 END AS wt FROM w
    UNION ALL SELECT p_partkey, concat('c:', substr(concat('^', w, '$'), i, 3)), 0.45 / sqrt(length(w)) FROM
      (SELECT p_partkey, w, unnest(generate_series(1, length(w))) AS i FROM w)
    UNION ALL SELECT p_partkey, concat('b:', toks[i], '_', toks[i + 1]), 0.35 FROM
      (SELECT p_partkey, toks, unnest(generate_series(1, len(toks) - 1)) AS i FROM t)),
  h AS (SELECT feat, {fnv('feat')} AS h FROM (SELECT DISTINCT feat FROM f)),
  s AS (SELECT p_partkey, h % 256 AS bucket, sum(CASE WHEN (h >> 16) & 1 = 1 THEN wt ELSE -wt END) AS v FROM f JOIN h USING (feat)
    GROUP BY 1, 2),
  n AS (SELECT p_partkey, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1)
  SELECT p_partkey, bucket, floor(floor(v / norm * 1000000 + 0.5) / 1000000 * 10000 + 0.5) / 10000 AS v FROM s JOIN n USING (p_partkey)
  WHERE abs(v / norm) > 0.001""")
def v2(spark, d):
    text = F.upper(F.concat_ws(" ", "p_name", "p_type", "p_size"))
    e = table(spark, d, "part").select("p_partkey", embed.embed_tokens(F.split(text, " ")).alias("v"))
    return e.select("p_partkey", F.posexplode("v").alias("bucket", "v")).filter("abs(v) > 0.001").select(
        "p_partkey", F.col("bucket").cast("bigint").alias("bucket"), half_up(F.col("v"), 4).alias("v"))


@query("v3_cosine", """SELECT a.vec_id AS a_id, floor(list_cosine_similarity(a.embedding, b.embedding) * 10000 + 0.5) / 10000 AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def v3(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a_id"), half_up(
        V.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


@query("v5_levenshtein_ratio", oracle("""SELECT pair_key, floor((1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS
  DOUBLE)) * 1000 + 0.5) / 1000 AS ratio FROM pr""", PAIR))
def v5(spark, d):
    return _pairs(spark, d).select("pair_key", half_up(V.levenshtein_ratio(F.col("a"), F.col("b"))).alias("ratio"))


@query("v6_jaro_winkler")
def v6(spark, d):
    return _pairs(spark, d).select("pair_key", half_up(V.jaro_winkler(F.col("a"), F.col("b"))).alias("jw"))


@query("v7_sorted_tokens", oracle("""SELECT pair_key, array_to_string(list_sort(list_distinct(string_split(upper(a), ' '))), ' ') AS
  a_sorted FROM pr""", PAIR))
def v7(spark, d):
    return _pairs(spark, d).select("pair_key", V.sorted_tokens(F.split(F.upper("a"), " ")).alias("a_sorted"))


@query("v8_token_jaccard", oracle("""SELECT pair_key, floor(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS
  DOUBLE) * 1000 + 0.5) / 1000 AS jaccard FROM (SELECT pair_key, list_distinct(string_split(upper(a), ' ')) AS x,
  list_distinct(string_split(upper(b), ' ')) AS y FROM pr)""", PAIR))
def v8(spark, d):
    w = lambda c: F.split(F.upper(c), " ")
    return _pairs(spark, d).select("pair_key", half_up(V.token_jaccard(w("a"), w("b"))).alias("jaccard"))


def grams(c: str) -> str:
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: "
            f"list_transform(generate_series(1, length(w) + 1), lambda i: substr(concat('  ', w, ' '), i, 3)))))")


@query("v10_trigram_similarity", oracle(f"""SELECT pair_key, floor(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x,
  y))) AS DOUBLE) * 1000 + 0.5) / 1000 AS sim FROM (SELECT pair_key, {grams('a')} AS x, {grams('b')} AS y FROM pr)""", PAIR))
def v10(spark, d):
    return _pairs(spark, d).select("pair_key", half_up(V.trigram_similarity(F.col("a"), F.col("b"))).alias("sim"))


@query("k7_trigram_search", oracle(f"""SELECT request_id, record_id, floor(sim * 1000 + 0.5) / 1000 AS sim FROM (
  SELECT q.n_nationkey AS request_id, t.record_id, count(*) / CAST(max(q.c) + max(t.c) - count(*) AS DOUBLE) AS sim FROM
  (SELECT n_nationkey, unnest(g) AS gram, len(g) AS c FROM (SELECT n_nationkey, {grams("concat('GATE VALVE ', n_nationkey, ' INCH')")}
   AS g FROM nation)) q JOIN (SELECT record_id, unnest(g) AS gram, len(g) AS c FROM (SELECT record_id, {grams('description')} AS g
   FROM raw)) t USING (gram) GROUP BY 1, 2) WHERE sim >= 0.3"""))
def k7(spark, d):
    from ..plans.views import trigram_index, trigram_search

    req = table(spark, d, "nation").select(F.col("n_nationkey").alias("request_id"), F.concat(
        F.lit("GATE VALVE "), "n_nationkey", F.lit(" INCH")).alias("term"))
    rows, texts = described(spark, d)
    found = trigram_search(req, trigram_index(texts, "description", "description"), "description")
    return rows.join(found, "description").select("request_id", "record_id", half_up(F.col("sim")).alias("sim"))


def described(spark, d):
    """(record_id, description) of every record, and the distinct descriptions, dealt over all tasks and written once: a
    text is searched once, and its hits are joined to the records that hold it."""
    rows = Domain(spark, d).raw.select("record_id", "description")
    return rows, computed_once(rows, ["description"], lambda t: t)


@query("x6_fuzzy_lookup", oracle(f"""SELECT record_id, floor(s * 1000 + 0.5) / 1000 AS sim FROM (SELECT record_id, org, legacy_code,
  description, len(list_intersect(g, q)) / CAST(len(list_distinct(list_concat(g, q))) AS DOUBLE) AS s FROM (SELECT *,
  {grams('description')} AS g, {grams("'HEX BOLT M16'")} AS q FROM raw)) WHERE s >= 0.3 OR description ILIKE '%HEX BOLT M16%'
  ORDER BY floor(s * 1000 + 0.5) / 1000 DESC, org, legacy_code, record_id LIMIT 25"""))
def x6f(spark, d):
    from ..plans.views import fuzzy_lookup

    x = Domain(spark, d)
    norm = x.raw.select("record_id", F.col("description").alias("normalized"))
    return fuzzy_lookup("HEX BOLT M16", x.raw, norm, x.mappings, x.canonical).select("record_id", "sim")


@query("v11_price_similarity", oracle("""SELECT pair_key, floor(greatest(0, least(1, 1 - abs(ln(pa / pb)) / ln(2.5))) * 1000 + 0.5) /
  1000 AS sim FROM pr""", PAIR))
def v11(spark, d):
    return _pairs(spark, d).select("pair_key", half_up(V.price_similarity(F.col("pa"), F.col("pb"))).alias("sim"))


@query("v12_class_similarity", oracle("""SELECT a.record_id AS a_id, CASE WHEN a.family <> b.family THEN 0.0 WHEN a.family =
  'UNCLASSIFIED' THEN 0.8 WHEN a.noun = b.noun THEN 1.0 ELSE 0.4 END AS sim FROM raw a JOIN raw b ON b.pk = a.pk + 1 AND b.rg = a.rg"""))
def v12(spark, d):
    x = Domain(spark, d)
    s = lambda p: x.raw.select((F.col("pk") - (1 if p == "b" else 0)).alias("pk"), "rg", F.col("record_id").alias(f"{p}_id"), F.col(
        "family").alias(f"f{p}"), F.when(F.col("family") != "UNCLASSIFIED", F.col("noun")).alias(f"n{p}"))
    return s("a").join(s("b"), ["pk", "rg"]).select("a_id", V.class_similarity(
        F.col("fa"), F.col("fb"), F.col("na"), F.col("nb")).alias("sim"))
