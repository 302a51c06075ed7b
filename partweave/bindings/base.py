"""Domain tables derived from the driver's tables (one SQL text for Spark and for the oracle) and the query registry."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: str, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {index} % {len(values)} {arms} END)"


B = "CAST(split_part(p_brand, '#', 2) AS INT)"
S = "p_size"
SHAPES = {
    "noun": "split_part(p_name, ' ', 2)",
    "family": ("(CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'BEARING' WHEN 'plate' THEN 'VALVE' WHEN 'widget' THEN "
               "'CABLE' WHEN 'bolt' THEN 'FASTENER' WHEN 'rod' THEN 'FASTENER' WHEN 'gear' THEN 'PUMP' ELSE "
               "'UNCLASSIFIED' END)"),
    "desig": pick(S, "6204", "6205", "6206", "6207", "6208", "6305", "6308", "6310"),
    "bore": pick(S, "20", "25", "30", "35", "40", "25", "40", "50"),
    "od": pick(S, "47", "52", "62", "72", "80", "62", "90", "110"),
    "width": pick(S, "14", "15", "16", "17", "18", "17", "23", "27"),
    "seal": pick(B, "2RS", "ZZ", "OPEN"),
    "clear": pick(S, "C3", "C4"),
    "vtype": pick(B, "GATE", "GLOBE", "BALL", "CHECK"),
    "vabbr": pick(B, "GT", "GLB", "BALL", "CHK"),
    "inch": pick(S, "2", "3", "4", "6", "8"),
    "dn": pick(S, "50", "80", "100", "150", "200"),
    "cls": pick(B, "150", "300", "600"),
    "body": pick(S, "WCB", "WCC", "CF8M", "A105"),
    "material": pick(S, "CS-WCB", "CS-WCC", "SS316", "CS-A105"),
    "cores": pick(B, "3", "3.5", "4"),
    "sec": pick(S, "16", "25", "50", "95", "120"),
    "cond": pick(B, "AL", "CU"),
    "condword": pick(B, "ALUMINIUM", "COPPER"),
    "condalt": pick(B, "ALU", "CU"),
    "ccode": pick(B, "A2XWY", "2XWY"),
    "dia": pick(S, "8", "10", "12", "16", "20", "24"),
    "pitch": pick(S, "1.25", "1.5", "1.75", "2.0", "2.5", "3.0"),
    "len": f"(20 + 5 * {B})",
    "grade": pick(S, "8.8", "10.9", "12.9"),
    "finish": pick(B, "HDG", "ZP", "BLK"),
    "finishword": pick(B, "HOT DIP GALVANISED", "ZINC PLATED", "BLACK"),
    "flow": pick(S, "10", "20", "30", "40", "50", "60", "70", "80", "90", "100"),
    "head": pick(B, "20", "25", "30", "35", "40", "45"),
    "kw": pick(S, "5.5", "7.5", "11", "15"),
    "encl": pick(B, "FLP", "TEFC"),
    "make": pick(B, "SKF", "KSB", "LPS", "KEI", "BDK"),
}
# description per organisation dialect (0..4)
TEXTS = {
    "ring": ["'BRG,DGBB,', desig, sealdash, ',', clear",
             "'BEARING, BALL, DEEP GROOVE, ', desig, sealdash, ', ', clear, ' CLEARANCE'",
             "'Ball Bearing ', desig, ' ', sealword, ' ', clear",
             "desig, ' ', sealword, ' ', clear, ' BALL BRG'",
             "'DGBB ', desig, sealdash, '/', clear"],
    "plate": ["'VLV,', vabbr, ',', inch, '\"', ',', cls, '#,', body, ',RF'",
              "'VALVE, ', vtype, ', ', dn, 'NB, CLASS ', cls, ', ', body, ', FLANGED RF'",
              "vtype, ' Valve ', inch, '\" ', CASE WHEN lean = 1 THEN '' ELSE concat(cls, '# ') END, body, ' Flanged RF'",
              "inch, '\" ', vtype, ' VALVE ', body, ' ', cls, ' LB RF ENDS'",
              "'VALVE ', vtype, ' DN', dn, ' CL', cls, ' ', body, ' RF'"],
    "widget": ["'CBL,PWR,1.1KV,', cores, 'CX', sec, 'SQMM,', cond, ',XLPE,ARMD'",
               "'CABLE, POWER, 1.1KV, ', condword, ', XLPE, ', cores, 'C X ', sec, ' SQ.MM, ARMOURED'",
               "'Power Cable 1.1KV ', cores, ' Core ', sec, ' sqmm ', cond, ' XLPE Armoured'",
               "sec, ' SQMM ', cores, ' CORE ', condalt, ' XLPE ARMOURED POWER CABLE 1100V'",
               "'CABLE 1.1KV ', ccode, ' ', cores, 'CX', sec"],
    "bolt": ["'BOLT,HEX,M', dia, 'X', len, ',GR', grade, ',', finish",
             "'BOLT, HEX HEAD, M', dia, ' X ', len, ' MM, PROPERTY CLASS ', grade, ', ', finishword",
             "'Hex Bolt M', dia, 'x', len, ' ', grade, ' ', finish",
             "'HHB M', dia, ' X ', len, ' ', grade, ' ', finish",
             "'HEX BOLT M', dia, 'X', pitch, 'X', len, ' CL ', grade, ' ', finish"],
    "rod": ["'STUD,M', dia, 'X', len, ',A193 B7,BLK'"] + ["'STUD BOLT M', dia, ' X ', len, ' MM A193 B7 BLACK'"] * 4,
    "gear": ["'PUMP,CENT,', flow, 'M3/HR,', head, 'MHD,', kw, 'KW,', encl",
             "'PUMP, CENTRIFUGAL, ', flow, ' M3/H, ', head, ' M HEAD, ', kw, ' KW ', encl",
             "'Centrifugal Pump ', flow, ' M3/H ', head, 'm Head ', kw, 'KW ', encl",
             "'CENTRIFUGAL PUMP SET Q=', flow, ' M3/H H=', head, ' M ', kw, 'KW ', encl",
             "'PUMP CENTRIFUGAL ', flow, ' M3/H ', head, ' M HEAD ', kw, ' KW ', encl"],
}


def _description() -> str:
    arms = []
    for noun, texts in TEXTS.items():
        for r, t in enumerate(texts):
            arms.append(f"WHEN noun = '{noun}' AND rg = {r} THEN concat({t})")
    return "CASE " + " ".join(arms) + " ELSE concat('GASKET ', upper(p_name), ' ', p_size) END"


def raw_view(duck: bool) -> str:
    t = (lambda n: n) if duck else (lambda n: "{" + n + "}")
    sha = (lambda x: f"sha256({x})") if duck else (lambda x: f"sha2({x}, 256)")
    shapes = ", ".join(f"{v} AS {k}" for k, v in SHAPES.items())
    cable = pick("rg", "M", "RM", "KM", "MTR", "MT")
    other = pick("rg", "EA", "NOS", "PCS", "NO.", "EA")
    carried = ", ".join(SHAPES)
    return f"""
SELECT {sha("concat(r_name, '|M', pk, '-', rg)")} AS record_id, pk, rg, r_name AS org,
  concat('M', pk, '-', rg) AS legacy_code, {_description()} AS description,
  CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 9 = 0 AND rg = 3 THEN 'BOX' WHEN noun = 'widget' THEN {cable}
       ELSE {other} END AS uom,
  CASE WHEN rg < 2 THEN make END AS manufacturer, CASE WHEN rg < 2 THEN concat('PN-', pk) END AS part_number,
  price, qty, concat('B', rg) AS batch_id, concat('T', pk) AS truth_key, p_name, p_size, p_type, p_brand, lean, {carried}
FROM (
  SELECT b.pk, b.rg, b.price, b.qty, r.r_name, part.p_name, part.p_size, part.p_type, part.p_brand, {shapes},
    CASE WHEN b.rg = 2 AND p_size % 10 = 7 THEN 1 ELSE 0 END AS lean,
    CASE WHEN {SHAPES['seal']} = 'OPEN' THEN '' ELSE concat('-', {SHAPES['seal']}) END AS sealdash,
    CASE WHEN {SHAPES['seal']} = 'OPEN' THEN '' ELSE {SHAPES['seal']} END AS sealword
  FROM (SELECT l_partkey AS pk, n_regionkey AS rg, floor(max(l_extendedprice / l_quantity) * 100 + 0.5) / 100 AS price,
               sum(l_quantity) AS qty
        FROM {t('lineitem')} li JOIN {t('supplier')} su ON l_suppkey = s_suppkey
        JOIN {t('nation')} na ON s_nationkey = n_nationkey GROUP BY l_partkey, n_regionkey) b
  JOIN {t('region')} r ON r.r_regionkey = b.rg
  JOIN {t('part')} part ON part.p_partkey = b.pk
) x"""


def recs_view(raw: str) -> str:
    """Candidate pairs: the same part in neighbouring organisations, scored by price agreement."""
    return f"""
SELECT concat(least(a_record_id, b_record_id), '::', greatest(a_record_id, b_record_id)) AS pair_key, w.*,
  CASE WHEN match_type IN ('IDENTICAL', 'DUPLICATE') THEN CASE WHEN final_score >= 0.95 THEN 'AUTO_QUEUE' ELSE 'REVIEW' END
       WHEN match_type IN ('NEAR_DUPLICATE', 'FUNCTIONALLY_EQUIVALENT') THEN
         CASE WHEN final_score >= 0.75 THEN 'REVIEW' ELSE 'UNRESOLVED' END
       WHEN match_type = 'INSUFFICIENT_DATA' THEN 'UNRESOLVED' ELSE 'NONE' END AS routing
FROM (
  SELECT v.*,
    CASE WHEN vetoed THEN 'RELATED_BUT_NOT_EQUIVALENT' WHEN pk % 13 = 0 THEN 'INSUFFICIENT_DATA'
         WHEN raw_score >= 0.95 AND pk % 3 = 0 THEN 'IDENTICAL' WHEN raw_score >= 0.95 THEN 'DUPLICATE'
         WHEN raw_score >= 0.85 THEN 'NEAR_DUPLICATE' WHEN raw_score >= 0.7 THEN 'FUNCTIONALLY_EQUIVALENT'
         WHEN raw_score >= 0.45 THEN 'RELATED_BUT_NOT_EQUIVALENT' ELSE 'NOT_MATCHED' END AS match_type,
    CASE WHEN vetoed AND raw_score > 0.69 THEN 0.69 ELSE raw_score END AS final_score
  FROM (
    SELECT a.pk, a.rg, a.record_id AS a_record_id, b.record_id AS b_record_id, a.family AS category,
      floor((1 - abs(a.price - b.price) / greatest(a.price, b.price)) * 1000 + 0.5) / 1000 AS raw_score,
      a.pk % 11 = 0 AS vetoed,
      CASE a.pk % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'NEEDS_INFO'
           ELSE 'PENDING' END AS status,
      CASE WHEN a.pk % 5 < 3 THEN CAST(concat('2024-01-', CASE WHEN 1 + a.pk % 31 < 10 THEN '0' ELSE '' END, 1 + a.pk % 31)
           AS DATE) END AS decided_at
    FROM {raw} a JOIN {raw} b ON a.pk = b.pk AND b.rg = a.rg + 1
  ) v
) w"""


MAPPINGS = """
SELECT record_id, pk, concat('IN-MAT-', pk) AS cnmc, org, legacy_code,
  CASE WHEN (pk * 5 + rg) % 4 = 0 THEN 'REVERSED' ELSE 'ACTIVE' END AS status,
  CASE WHEN pk % 2 = 0 THEN 'DUPLICATE' ELSE 'NEAR_DUPLICATE' END AS match_type, 0.9 AS confidence
FROM {raw} m WHERE pk % 6 <> 5"""
CANONICAL = """
SELECT concat('IN-MAT-', pk) AS cnmc, concat('NMC-', pk) AS short_code, concat('MATERIAL ', pk) AS description,
  min(family) AS category, CASE WHEN pk % 20 = 0 THEN 'RETIRED' ELSE 'APPROVED' END AS status, pk
FROM {raw} c WHERE pk % 6 <> 5 GROUP BY pk"""
TASK_STATUS = """CASE WHEN status IN ('APPROVED', 'REJECTED') THEN 'DONE' WHEN status = 'NEEDS_INFO' THEN 'NEEDS_INFO' ELSE 'OPEN' END"""
TASKS = f"""
SELECT pair_key,
  CASE routing WHEN 'AUTO_QUEUE' THEN 'FAST_TRACK' WHEN 'REVIEW' THEN 'FULL_REVIEW' ELSE 'UNRESOLVED' END AS queue,
  CASE match_type WHEN 'FUNCTIONALLY_EQUIVALENT' THEN 1 WHEN 'NEAR_DUPLICATE' THEN 2 WHEN 'INSUFFICIENT_DATA' THEN 4
    ELSE 3 END AS priority,
  {TASK_STATUS}
    AS status
FROM {{recs}} t WHERE routing <> 'NONE'"""

# what DuckDB sees in front of every oracle query
WITH = ("WITH RECURSIVE raw AS (" + raw_view(True) + "),\nrecs AS (" + recs_view("raw") + "),\nmappings AS ("
        + MAPPINGS.format(raw="raw") + "),\ncanonical AS (" + CANONICAL.format(raw="raw") + "),\ntasks AS ("
        + TASKS.format(recs="recs") + ")")


def oracle(body: str, *ctes: str) -> str:
    return WITH + "".join(f",\n{c}" for c in ctes) + "\n" + body


class Domain:
    """The derived tables of one data directory as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        used = {n: table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation", "region", "part")}
        self.raw = spark.sql(raw_view(False), **used)

    @property
    def recs(self) -> DataFrame:
        return self.spark.sql(recs_view("{raw}"), raw=self.raw)

    @property
    def mappings(self) -> DataFrame:
        return self.spark.sql(MAPPINGS, raw=self.raw)

    @property
    def canonical(self) -> DataFrame:
        return self.spark.sql(CANONICAL, raw=self.raw)

    @property
    def tasks(self) -> DataFrame:
        return self.spark.sql(TASKS, recs=self.recs)

    def inputs(self) -> DataFrame:
        """Raw records with the columns ``process_records`` reads."""
        return self.raw.select("record_id", "pk", "rg", "org", "legacy_code", "description", F.lit(None).cast(
            "string").alias("long_text"), "uom", "manufacturer", "part_number", "price", "qty", "batch_id", "truth_key")
