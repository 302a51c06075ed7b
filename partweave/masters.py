"""Reference masters: the small tables that drive every stage.

Everything in this module is a fixed value (word lists, lookup tables, weights, thresholds).  They are kept as plain
Python literals because they are tiny, bounded by the domain vocabulary and never grow with the data; callers turn
them into literals inside Column expressions or into broadcast-size DataFrames.  Every public operator takes the
master it needs as a parameter and only defaults to these.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

CATEGORIES = ["BEARING", "VALVE", "CABLE", "FASTENER", "PUMP"]
UNCLASSIFIED = "UNCLASSIFIED"
PENDING = "PENDING"

# --------------------------------------------------------------------------------------------------------------
# Category attribute schemas
# (key, label, group, type, unit, weight, required, identity, veto, tolerance)
# --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    group: str
    type: str
    unit: str | None = None
    weight: float = 0.0
    required: bool = False
    identity: bool = False
    veto: str | None = None
    tolerance: float = 0.0


@dataclass(frozen=True)
class CategorySchema:
    code: str
    name: str
    prefix: str
    unspsc: str
    uom_dimension: str
    blocking_keys: tuple[str, ...]
    type_key: str
    fields: tuple[Field, ...] = field(default_factory=tuple)


def _f(key, label, group, type_, unit, weight, flags="", veto=None, tol=0.0):
    return Field(key, label, group, type_, unit, float(weight), "R" in flags, "I" in flags, veto, tol)


SCHEMAS: dict[str, CategorySchema] = {
    "BEARING": CategorySchema(
        "BEARING", "Bearings", "BRG", "31171500", "COUNT", ("designation",), "bearing_type",
        (
            _f("bearing_type", "Bearing type", "attribute", "text", None, 3, "RI"),
            _f("designation", "ISO designation", "attribute", "text", None, 4, "RI", "SIZE"),
            _f("seal_type", "Seal / shield", "attribute", "text", None, 2, "I"),
            _f("bore_mm", "Bore", "dimension", "number", "mm", 3, "", None, 0.001),
            _f("outer_diameter_mm", "Outer diameter", "dimension", "number", "mm", 3, "", None, 0.001),
            _f("width_mm", "Width", "dimension", "number", "mm", 2, "", None, 0.01),
            _f("clearance", "Radial clearance", "specification", "text", None, 3, "I"),
            _f("cage", "Cage material", "specification", "text", None, 1),
            _f("manufacturer", "Make", "descriptive", "text", None, 0),
        ),
    ),
    "VALVE": CategorySchema(
        "VALVE", "Valves", "VLV", "40141600", "COUNT", ("valve_type", "size_dn"), "valve_type",
        (
            _f("valve_type", "Valve type", "attribute", "text", None, 3, "RI"),
            _f("end_connection", "End connection", "attribute", "text", None, 2, "I"),
            _f("operation", "Operation", "attribute", "text", None, 1),
            _f("size_dn", "Nominal size", "dimension", "number", "DN", 3, "RI", "SIZE"),
            _f("pressure_class", "Pressure class", "specification", "text", None, 3, "RI", "PRESSURE_CLASS"),
            _f("body_material", "Body material", "specification", "text", None, 3, "RI", "MATERIAL_GRADE"),
            _f("trim", "Trim", "specification", "text", None, 1),
            _f("design_standard", "Design standard", "specification", "text", None, 1),
            _f("fire_safe", "Fire-safe certification", "specification", "text", None, 2, "", "CERTIFICATION"),
            _f("manufacturer", "Make", "descriptive", "text", None, 0),
        ),
    ),
    "CABLE": CategorySchema(
        "CABLE", "Cables", "CBL", "26121600", "LENGTH", ("cross_section_sqmm", "cores"), "cable_type",
        (
            _f("cable_type", "Cable type", "attribute", "text", None, 2, "RI"),
            _f("armour", "Armour", "attribute", "text", None, 2, "I"),
            _f("cores", "Cores", "dimension", "number", None, 3, "RI", "SIZE"),
            _f("cross_section_sqmm", "Cross-section", "dimension", "number", "mm²", 3, "RI", "SIZE"),
            _f("voltage_grade_kv", "Voltage grade", "specification", "number", "kV", 3, "RI", "VOLTAGE"),
            _f("conductor", "Conductor", "specification", "text", None, 3, "RI", "MATERIAL_GRADE"),
            _f("insulation", "Insulation", "specification", "text", None, 2, "I"),
            _f("fire_performance", "Fire performance", "specification", "text", None, 2, "", "CERTIFICATION"),
            _f("standard", "Standard", "specification", "text", None, 1),
        ),
    ),
    "FASTENER": CategorySchema(
        "FASTENER", "Fasteners", "FST", "31161600", "COUNT", ("fastener_type", "thread_size"), "fastener_type",
        (
            _f("fastener_type", "Fastener type", "attribute", "text", None, 3, "RI"),
            _f("finish", "Finish / coating", "attribute", "text", None, 1.5, "I"),
            _f("thread", "Thread", "specification", "text", None, 3, "RI", "THREAD"),
            _f("grade", "Grade / property class", "specification", "text", None, 3, "RI", "MATERIAL_GRADE"),
            _f("standard", "Standard", "specification", "text", None, 0.5),
            _f("thread_size", "Nominal diameter", "dimension", "text", None, 0),
            _f("length_mm", "Length", "dimension", "number", "mm", 3, "I", "SIZE", 0.001),
        ),
    ),
    "PUMP": CategorySchema(
        "PUMP", "Pumps", "PMP", "40151500", "COUNT", ("pump_type",), "pump_type",
        (
            _f("pump_type", "Pump type", "attribute", "text", None, 3, "RI"),
            _f("flow_m3h", "Rated flow", "dimension", "number", "m³/h", 3, "RI", None, 0.03),
            _f("head_m", "Rated head", "dimension", "number", "m", 3, "RI", None, 0.03),
            _f("motor_kw", "Motor rating", "specification", "number", "kW", 2, "I", None, 0.03),
            _f("moc", "Material of construction", "specification", "text", None, 2, "I", "MATERIAL_GRADE"),
            _f("motor_enclosure", "Motor enclosure / hazardous area", "specification", "text", None, 2, "I",
               "CERTIFICATION"),
            _f("design_standard", "Design standard", "specification", "text", None, 1),
            _f("manufacturer", "Make", "descriptive", "text", None, 0),
        ),
    ),
}

# --------------------------------------------------------------------------------------------------------------
# Engine weights, thresholds and calibration
# --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    weights: dict = field(default_factory=lambda: {
        "semantic": 0.3, "attribute": 0.25, "specification": 0.15, "dimension": 0.1,
        "classification": 0.08, "uom": 0.07, "procurement": 0.05,
    })
    duplicate: float = 0.95
    near_duplicate: float = 0.85
    functional: float = 0.7
    related: float = 0.45
    auto_queue: float = 0.95
    review: float = 0.75
    cosine_floor: float = 0.25
    cosine_ceil: float = 0.8
    missing_history: str = "renormalize"
    knn: int = 8
    directional_substitution: bool = False

    def with_(self, **kw) -> "EngineConfig":
        return replace(self, **kw)

    def __post_init__(self):
        w = self.weights
        if set(w) != set(COMPONENTS) or any(v < 0 for v in w.values()) or sum(w.values()) <= 0:
            raise ValueError("weights must give a non-negative value for each component and a positive total")
        if not (1 >= self.duplicate >= self.near_duplicate >= self.functional >= self.related >= 0):
            raise ValueError("thresholds must descend: duplicate >= near_duplicate >= functional >= related")
        if self.missing_history not in ("renormalize", "zero"):
            raise ValueError("missing_history is 'renormalize' or 'zero'")


COMPONENTS = ["semantic", "attribute", "specification", "dimension", "classification", "uom", "procurement"]
DEFAULT_CONFIG = EngineConfig()

VETO_RULES = {
    "PRESSURE_CLASS": ("VETO_PRESSURE_CLASS_MISMATCH",
                       "a lower-rated component cannot be installed in a higher-pressure service"),
    "MATERIAL_GRADE": ("VETO_MATERIAL_GRADE_MISMATCH",
                       "material grade governs corrosion resistance, temperature limits and weldability"),
    "VOLTAGE": ("VETO_VOLTAGE_MISMATCH",
                "insulation is rated for a specific system voltage; substitution is an electrical safety hazard"),
    "CERTIFICATION": ("VETO_CERTIFICATION_MISMATCH",
                      "certification (fire-safe / flameproof / fire-performance) is a statutory or safety requirement"),
    "THREAD": ("VETO_THREAD_MISMATCH", "mismatched threads cannot be assembled and may strip under load"),
    "SIZE": ("VETO_SIZE_MISMATCH",
             "physical size / designation differs, so the parts are not dimensionally interchangeable"),
}

# (category, attribute key, from value, to value, bidirectional, rationale)
SUBSTITUTION_RULES = [
    ("PUMP", "moc", "SS304", "SS316", False,
     "SS316 wetted parts exceed SS304 corrosion resistance for water/utility service"),
    ("FASTENER", "grade", "8.8", "10.9", False,
     "Property class 10.9 may replace 8.8 in non-structural, non-sour, non-HDG-critical joints subject to "
     "hydrogen-embrittlement check"),
    ("VALVE", "body_material", "CS-WCB", "CS-WCC", False,
     "A216 WCC has higher tensile strength with the same P-number; acceptable replacement for WCB per ASME B16.34"),
    ("VALVE", "body_material", "SS316", "SS316L", True,
     "Dual-certified 316/316L castings are common; L-grade acceptable where design temperature < 425 C"),
]

QUEUE_OF_ROUTING = {"AUTO_QUEUE": "FAST_TRACK", "REVIEW": "FULL_REVIEW", "UNRESOLVED": "UNRESOLVED"}
APPROVABLE = ["IDENTICAL", "DUPLICATE", "NEAR_DUPLICATE", "FUNCTIONALLY_EQUIVALENT"]
POSITIVE = ["IDENTICAL", "DUPLICATE", "NEAR_DUPLICATE"]

# --------------------------------------------------------------------------------------------------------------
# Units of measure (code, name, dimension, base code, factor to base, ISO code, aliases)
# --------------------------------------------------------------------------------------------------------------
UOM_MASTER = [
    ("EA", "Each", "COUNT", "EA", 1.0, "EA",
     ["EACH", "NOS", "NOS.", "NO", "NO.", "NUMBER", "NUMBERS", "PC", "PCS", "PCS.", "PIECE", "PIECES", "UN", "UNIT",
      "UNITS", "ST", "EA."]),
    ("SET", "Set", "SET", "SET", 1.0, "SET", ["SETS", "ST."]),
    ("PR", "Pair", "PAIR", "PR", 1.0, "PR", ["PAIR", "PAIRS", "PRS"]),
    ("M", "Metre", "LENGTH", "M", 1.0, "MTR",
     ["MTR", "MTRS", "METER", "METERS", "METRE", "METRES", "RM", "RMT", "R.M.", "RUNNING METRE", "LM", "MTR."]),
    ("KM", "Kilometre", "LENGTH", "M", 1000.0, "KMT", ["KMS", "KILOMETRE", "KILOMETER"]),
    ("FT", "Foot", "LENGTH", "M", 0.3048, "FOT", ["FEET", "FOOT"]),
    ("KG", "Kilogram", "MASS", "KG", 1.0, "KGM", ["KGS", "KILOGRAM", "KILOGRAMS", "KG."]),
    ("TO", "Metric tonne", "MASS", "KG", 1000.0, "TNE", ["TONNE", "TONNES", "TON", "TONS", "TE"]),
    ("L", "Litre", "VOLUME", "L", 1.0, "LTR", ["LTR", "LTRS", "LITRE", "LITER", "LT"]),
    ("KL", "Kilolitre", "VOLUME", "L", 1000.0, "KLT", ["KILOLITRE"]),
]

# --------------------------------------------------------------------------------------------------------------
# UNSPSC classification (category, subtype, code, title)
# --------------------------------------------------------------------------------------------------------------
CLASSIFICATION_MASTER = [
    ("BEARING", None, "31171500", "Bearings"),
    ("BEARING", "DEEP_GROOVE_BALL", "31171504", "Ball bearings"),
    ("BEARING", "ANGULAR_CONTACT_BALL", "31171504", "Ball bearings"),
    ("BEARING", "CYLINDRICAL_ROLLER", "31171505", "Roller bearings"),
    ("BEARING", "SPHERICAL_ROLLER", "31171505", "Roller bearings"),
    ("BEARING", "TAPER_ROLLER", "31171505", "Roller bearings"),
    ("VALVE", None, "40141600", "Valves"),
    ("VALVE", "GATE", "40141609", "Gate valves"),
    ("VALVE", "GLOBE", "40141610", "Globe valves"),
    ("VALVE", "BALL", "40141607", "Ball valves"),
    ("VALVE", "CHECK", "40141604", "Check valves"),
    ("VALVE", "BUTTERFLY", "40141608", "Butterfly valves"),
    ("CABLE", None, "26121600", "Electrical cable and accessories"),
    ("CABLE", "POWER", "26121636", "Power cable"),
    ("CABLE", "CONTROL", "26121641", "Control cable"),
    ("CABLE", "INSTRUMENTATION", "26121643", "Instrumentation cable"),
    ("FASTENER", None, "31161600", "Bolts"),
    ("FASTENER", "HEX_BOLT", "31161620", "Hex bolts"),
    ("FASTENER", "STUD_BOLT", "31161622", "Stud bolts"),
    ("FASTENER", "HEX_NUT", "31161700", "Nuts"),
    ("FASTENER", "WASHER", "31161800", "Washers"),
    ("PUMP", None, "40151500", "Pumps"),
    ("PUMP", "CENTRIFUGAL", "40151514", "Centrifugal pumps"),
    ("PUMP", "SUBMERSIBLE", "40151520", "Submersible pumps"),
    ("PUMP", "RECIPROCATING", "40151511", "Reciprocating pumps"),
]

# --------------------------------------------------------------------------------------------------------------
# Known makes, in lookup order
# --------------------------------------------------------------------------------------------------------------
KNOWN_MAKES = [
    "SKF", "FAG", "NSK", "NBC", "TIMKEN", "ZKL", "NTN", "KOYO", "SCHAEFFLER",
    "L&T", "AUDCO", "KSB", "KIRLOSKAR", "VIRGO", "MICROFINISH", "BDK", "OSWAL", "LEADER",
    "POLYCAB", "HAVELLS", "KEI", "FINOLEX", "UNIVERSAL", "GLOSTER",
    "UNBRAKO", "TVS", "LPS", "SUNDRAM",
    "FLOWSERVE", "SULZER", "GRUNDFOS", "CROMPTON", "WPIL", "BEACON", "MATHER", "JYOTI",
]

STOPWORDS = ["OF", "FOR", "THE", "AND", "TO", "AS", "PER", "WITH", "IN", "ON", "MAKE", "TYPE", "SIZE", "SUITABLE",
             "NEW", "ITEM", "MATERIAL"]
SEMANTIC_NOISE = ["OR", "EQUIVALENT", "MAKE", "EQV", "OEM", "APPROVED", "SIMILAR", "NOS", "WITH", "SET", "INCH", "MM",
                  "TYPE"]


# --------------------------------------------------------------------------------------------------------------
# Abbreviation and synonym dictionary
# Each line: category | kind | TERM=EXPANSION ; TERM=EXPANSION ...      ('*' = every category)
# --------------------------------------------------------------------------------------------------------------
_DICTIONARY_TEXT = """
* | ABBREVIATION | BRG=BEARING ; BRGS=BEARING ; BRNG=BEARING ; BEARINGS=BEARING
* | ABBREVIATION | VLV=VALVE ; VLVS=VALVE ; V/V=VALVE ; VALVES=VALVE ; CBL=CABLE ; CABL=CABLE ; CABLES=CABLE
* | ABBREVIATION | PMP=PUMP ; PUMPSET=PUMP SET ; BLT=BOLT ; BOLTS=BOLT ; HHB=HEX HEAD BOLT ; WSHR=WASHER
* | ABBREVIATION | WASHR=WASHER ; SCRW=SCREW ; SHCS=SOCKET HEAD CAP SCREW ; NUTS=NUT ; STUDS=STUD
* | ABBREVIATION | DGBB=DEEP GROOVE BALL BEARING ; DG=DEEP GROOVE ; SRB=SPHERICAL ROLLER BEARING ; SPH=SPHERICAL
* | ABBREVIATION | CRB=CYLINDRICAL ROLLER BEARING ; CYL=CYLINDRICAL ; TRB=TAPER ROLLER BEARING ; TPR=TAPER
* | ABBREVIATION | ACBB=ANGULAR CONTACT BALL BEARING ; ANG=ANGULAR
BEARING | ABBREVIATION | CONT=CONTACT
* | ABBREVIATION | RLR=ROLLER ; BRS=BRASS ; BRZ=BRONZE ; POLYAMIDE=POLYAMIDE
* | ABBREVIATION | GT=GATE ; GLB=GLOBE ; BFV=BUTTERFLY VALVE ; BTFY=BUTTERFLY ; BTRFLY=BUTTERFLY
* | ABBREVIATION | NRV=NON RETURN VALVE ; CHK=CHECK ; NB=NOMINAL BORE ; RF=RAISED FACE ; FF=FLAT FACE
* | ABBREVIATION | RTJ=RING TYPE JOINT ; FLGD=FLANGED ; FLG=FLANGED ; FLGE=FLANGED ; FLNG=FLANGED
* | ABBREVIATION | BW=BUTT WELD ; BWE=BUTT WELD ; SW=SOCKET WELD ; SWE=SOCKET WELD ; SCRD=SCREWED
* | ABBREVIATION | THRD=THREADED ; HW=HANDWHEEL ; H/W=HANDWHEEL
VALVE | ABBREVIATION | GO=GEAR OPERATED
* | ABBREVIATION | GR OPTD=GEAR OPERATED
VALVE | ABBREVIATION | LO=LEVER OPERATED
* | ABBREVIATION | LVR=LEVER ; MOV=MOTOR OPERATED VALVE ; ACTR=ACTUATOR
VALVE | ABBREVIATION | FB=FULL BORE ; RB=REDUCED BORE
* | ABBREVIATION | SCH=SCHEDULE ; TRM=TRIM
* | ABBREVIATION | CS=CARBON STEEL ; SS=STAINLESS STEEL ; CI=CAST IRON ; DI=DUCTILE IRON ; MS=MILD STEEL
* | ABBREVIATION | GI=GALVANISED IRON ; LTCS=LOW TEMPERATURE CARBON STEEL ; GM=GUN METAL
* | ABBREVIATION | CU=COPPER ; AL=ALUMINIUM ; ALU=ALUMINIUM ; ALUM=ALUMINIUM ; CST STL=CAST STEEL
* | ABBREVIATION | PWR=POWER ; CTRL=CONTROL ; CNTRL=CONTROL ; INSTR=INSTRUMENTATION
CABLE | ABBREVIATION | INST=INSTRUMENTATION
* | ABBREVIATION | ARMD=ARMOURED ; ARMRD=ARMOURED
CABLE | ABBREVIATION | ARM=ARMOURED
* | ABBREVIATION | UNARMD=UNARMOURED ; SWA=STEEL WIRE ARMOURED ; GSWA=STEEL WIRE ARMOURED
* | ABBREVIATION | GSFA=STEEL STRIP ARMOURED ; STRIP ARMD=STEEL STRIP ARMOURED
* | ABBREVIATION | FRLS=FIRE RETARDANT LOW SMOKE ; FRLSH=FIRE RETARDANT LOW SMOKE HALOGEN
* | ABBREVIATION | LSZH=LOW SMOKE ZERO HALOGEN ; XLPE=CROSS LINKED POLYETHYLENE ; COND=CONDUCTOR ; INSUL=INSULATED
CABLE | ABBREVIATION | HT=HIGH TENSION ; LT=LOW TENSION
* | ABBREVIATION | SQ.MM=SQMM ; SQ MM=SQMM ; SQ. MM=SQMM ; MM2=SQMM
* | ABBREVIATION | HDG=HOT DIP GALVANISED ; GALV=GALVANISED ; ZP=ZINC PLATED ; ZN PLTD=ZINC PLATED ; PLTD=PLATED
* | ABBREVIATION | BLK=BLACK ; GR=GRADE ; GR.=GRADE ; PROP CL=PROPERTY CLASS ; W/=WITH ; W/O=WITHOUT
* | ABBREVIATION | CENT=CENTRIFUGAL ; CENTF=CENTRIFUGAL ; CENTRI=CENTRIFUGAL ; SUBM=SUBMERSIBLE
* | ABBREVIATION | SUBMERS=SUBMERSIBLE ; RECIP=RECIPROCATING ; DWT=DEWATERING ; MOC=MATERIAL OF CONSTRUCTION
* | ABBREVIATION | FLP=FLAMEPROOF ; TEFC=TOTALLY ENCLOSED FAN COOLED ; MOT=MOTOR
PUMP | ABBREVIATION | HD=HEAD ; CAP=CAPACITY
* | ABBREVIATION | M3/HR=M3/H ; CUM/HR=M3/H ; M3PH=M3/H ; MECH SEAL=MECHANICAL SEAL ; M/SEAL=MECHANICAL SEAL
* | ABBREVIATION | GLD PKG=GLAND PACKING
* | ABBREVIATION | ASSY=ASSEMBLY ; SPL=SPECIAL ; STD=STANDARD ; SPEC=SPECIFICATION ; DRG=DRAWING
* | ABBREVIATION | MFR=MANUFACTURER ; MFG=MANUFACTURER ; MK=MAKE ; DIA=DIAMETER ; THK=THICKNESS
* | ABBREVIATION | LG=LENGTH ; LGTH=LENGTH ; QTY=QUANTITY ; APPROX=APPROXIMATELY ; EQUIV=EQUIVALENT
* | ABBREVIATION | EQV=EQUIVALENT ; REQD=REQUIRED ; ACC=ACCORDING
* | SYNONYM | NON RETURN VALVE=CHECK VALVE ; SWING CHECK=CHECK ; HEXAGONAL=HEX ; HEXAGON=HEX
* | SYNONYM | GALVANIZED=GALVANISED ; ALUMINUM=ALUMINIUM ; ARMORED=ARMOURED ; TAPERED=TAPER
* | SYNONYM | DEEP GROOVE BALL BEARING BEARING=DEEP GROOVE BALL BEARING
* | SYNONYM | BALL BEARING DEEP GROOVE=DEEP GROOVE BALL BEARING
* | SYNONYM | PUMP SET=PUMP ; PUMPING SET=PUMP ; METER=METRE ; CENTRES=CENTERS
"""


@dataclass(frozen=True)
class DictionaryEntry:
    term: str
    expansion: str
    kind: str
    category: str | None = None


def _read_dictionary(text: str) -> list[DictionaryEntry]:
    out = []
    for line in text.strip().splitlines():
        cat, kind, entries = (p.strip() for p in line.split("|", 2))
        for entry in entries.split(" ; "):
            term, expansion = entry.strip().split("=", 1)
            out.append(DictionaryEntry(term, expansion, kind, None if cat == "*" else cat))
    return out


DICTIONARY: list[DictionaryEntry] = _read_dictionary(_DICTIONARY_TEXT)
