"""Attribute facts of hand-checked descriptions, through normalise -> classify -> extract."""
from pyspark.sql import functions as F

from partweave.operators.process import process_records

from .helpers import SCHEMA, values

# family, description, facts
CASES = [
    ("BEARING", "BRG,DGBB,6205-2RS,C3", dict(bearing_type="DEEP_GROOVE_BALL", designation="6205", seal_type="2RS",
                                            clearance="C3", bore_mm=25, outer_diameter_mm=52, width_mm=15)),
    ("BEARING", "BEARING, BALL, DEEP GROOVE, 6205-2RS, C3 CLEARANCE, 25X52X15MM",
     dict(designation="6205", seal_type="2RS", clearance="C3", bore_mm=25)),
    ("BEARING", "Ball Bearing 6205 2RS C3 Make SKF",
     dict(bearing_type="DEEP_GROOVE_BALL", designation="6205", seal_type="2RS", manufacturer="SKF")),
    ("BEARING", "6205 ZZ C3 BALL BRG", dict(designation="6205", seal_type="ZZ", clearance="C3")),
    ("BEARING", "DGBB 6206-2RS1/C3 (ID30 OD62 W16)",
     dict(designation="6206", seal_type="2RS", clearance="C3", bore_mm=30, outer_diameter_mm=62, width_mm=16)),
    ("BEARING", "BRG,DGBB,6310,C3", dict(designation="6310", seal_type="OPEN", clearance="C3", outer_diameter_mm=110)),
    ("BEARING", "SPH RLR BRG 22210 E C3",
     dict(bearing_type="SPHERICAL_ROLLER", designation="22210", clearance="C3", width_mm=23)),
    ("BEARING", "CYLINDRICAL ROLLER BEARING NU310 ECP/C3",
     dict(bearing_type="CYLINDRICAL_ROLLER", designation="NU310", clearance="C3")),
    ("BEARING", "Taper Roller Bearing 30210", dict(bearing_type="TAPER_ROLLER", designation="30210", width_mm=21.75)),
    ("BEARING", "ANG CONT BRG 7310 BECBP", dict(bearing_type="ANGULAR_CONTACT_BALL", designation="7310")),
    ("BEARING", "BEARING 6208DDUC3 NSK",
     dict(designation="6208", seal_type="2RS", clearance="C3", manufacturer="NSK")),
    ("BEARING", "BEARING DEEP GROOVE 6305-2Z/C3 BRASS CAGE",
     dict(seal_type="ZZ", cage="BRASS", bore_mm=25, outer_diameter_mm=62)),
    ("VALVE", 'VLV,GT,4",150#,WCB,RF', dict(valve_type="GATE", size_dn=100, pressure_class="150",
                                            body_material="CS-WCB", end_connection="FLANGED_RF")),
    ("VALVE", "VALVE, GATE, 100NB, CLASS 150, A216 WCB, FLANGED RF, HANDWHEEL, API 600",
     dict(size_dn=100, pressure_class="150", operation="HANDWHEEL", design_standard="API 600")),
    ("VALVE", 'Gate Valve 4" 150# CS Flanged RF', dict(size_dn=100, body_material="CS", end_connection="FLANGED_RF")),
    ("VALVE", '4" GATE VALVE CAST STEEL WCB 150 LB RF ENDS',
     dict(size_dn=100, pressure_class="150", body_material="CS-WCB")),
    ("VALVE", "VALVE GATE DN100 PN20 WCB RF", dict(size_dn=100, pressure_class="150", body_material="CS-WCB")),
    ("VALVE", "VALVE GATE DN100 PN50 WCB RF", dict(pressure_class="300")),
    ("VALVE", 'VLV,GT,1-1/2",800#,A105,SW',
     dict(size_dn=40, pressure_class="800", body_material="CS-A105", end_connection="SOCKET_WELD")),
    ("VALVE", "VALVE, BALL, 50NB, CLASS 150, A351 CF8M, FLANGED RF, LEVER OPERATED, API 6D, FIRE SAFE API 607",
     dict(valve_type="BALL", body_material="SS316", operation="LEVER", fire_safe="API 607")),
    ("VALVE", "BALL VALVE 2 INCH 150# A351 CF8", dict(size_dn=50, body_material="SS304")),
    ("VALVE", 'NRV 6" 150# WCB RF SWING TYPE BS 1868',
     dict(valve_type="CHECK", size_dn=150, design_standard="BS 1868")),
    ("VALVE", 'BFV,10",150#,DI,WAFER',
     dict(valve_type="BUTTERFLY", size_dn=250, body_material="DI", end_connection="WAFER")),
    ("VALVE", 'Globe Valve 3" 300# WCB Flanged RF trim 8',
     dict(valve_type="GLOBE", size_dn=80, pressure_class="300", trim="API TRIM 8")),
    ("VALVE", 'VALVE GATE 1/2" CL800 ASTM A182 F316 SCRD NPT',
     dict(size_dn=15, body_material="SS316", end_connection="SCREWED")),
    ("CABLE", "CBL,PWR,1.1KV,3.5CX95SQMM,AL,XLPE,ARMD",
     dict(cable_type="POWER", voltage_grade_kv=1.1, cores=3.5, cross_section_sqmm=95, conductor="AL",
          insulation="XLPE")),
    ("CABLE", "CABLE, POWER, 1.1KV, ALUMINIUM, XLPE, 3.5C X 95 SQ.MM, STRIP ARMOURED, IS 7098-1",
     dict(armour="STRIP", standard="IS 7098-1")),
    ("CABLE", "LT Power Cable 3.5 Core 95 sqmm Al XLPE Armoured",
     dict(cores=3.5, cross_section_sqmm=95, conductor="AL", voltage_grade_kv=1.1)),
    ("CABLE", "95 SQMM 3.5 CORE ALU XLPE ARMOURED POWER CABLE 1100V",
     dict(cores=3.5, cross_section_sqmm=95, voltage_grade_kv=1.1, conductor="AL")),
    ("CABLE", "CABLE 1.1KV A2XFY 3.5CX95",
     dict(conductor="AL", insulation="XLPE", armour="STRIP", cable_type="POWER")),
    ("CABLE", "CABLE 1.1KV 2XWY 4CX16", dict(conductor="CU", armour="WIRE", cores=4, cross_section_sqmm=16)),
    ("CABLE", "CABLE, POWER, 6.35/11KV, AL, XLPE, 3C X 240 SQ.MM",
     dict(voltage_grade_kv=11, cores=3, cross_section_sqmm=240)),
    ("CABLE", "HT Power Cable 11KV 3 Core 185 sqmm Al XLPE Armoured",
     dict(voltage_grade_kv=11, cross_section_sqmm=185)),
    ("CABLE", "Control Cable 12 Core 1.5 sqmm Cu PVC Armoured FRLS",
     dict(cable_type="CONTROL", voltage_grade_kv=1.1, fire_performance="FRLS", insulation="PVC")),
    ("CABLE", "CBL,CTRL,1.1KV,12CX1.5SQMM,CU,PVC,ARMD,LSZH", dict(cable_type="CONTROL", fire_performance="LSZH")),
    ("CABLE", "CABLE 1.1KV YWY 7CX1.5 FRLS",
     dict(conductor="CU", insulation="PVC", armour="WIRE", cable_type="CONTROL", cores=7)),
    ("FASTENER", "BOLT,HEX,M16X80,GR8.8,HDG",
     dict(fastener_type="HEX_BOLT", thread="M16X2.0", length_mm=80, grade="8.8", finish="HDG")),
    ("FASTENER", "BOLT, HEX HEAD, M16 X 80 MM, PROPERTY CLASS 8.8, HOT DIP GALVANISED, IS 1364",
     dict(thread="M16X2.0", length_mm=80, standard="IS 1364")),
    ("FASTENER", "Hex Bolt M16x80 8.8 Gr. Galv.", dict(thread="M16X2.0", grade="8.8", finish="HDG")),
    ("FASTENER", "HHB M16 X 80 8.8 HDG", dict(fastener_type="HEX_BOLT", length_mm=80)),
    ("FASTENER", "HEX BOLT M16X2.0X80 CL 8.8 HDG ISO 4014",
     dict(thread="M16X2.0", length_mm=80, standard="ISO 4014")),
    ("FASTENER", "HEX BOLT M20X1.5X80 CL 8.8 HDG", dict(thread="M20X1.5", length_mm=80)),
    ("FASTENER", 'STUD,5/8"UNCX110,A193 B7,W/2 NUTS 2H',
     dict(fastener_type="STUD_BOLT", thread="5/8-11UNC", length_mm=110, grade="A193-B7")),
    ("FASTENER", "STUD BOLT, 5/8 INCH UNC, LENGTH 110 MM, ASTM A193 GR B7, WITH 2 NOS A194 2H NUTS",
     dict(thread="5/8-11UNC", length_mm=110, grade="A193-B7")),
    ("FASTENER", 'STUD BOLT 3/4"UNC X 130 A193 B7 W/ 2 NUTS A194 2H PTFE COATED',
     dict(thread="3/4-10UNC", finish="PTFE_COATED")),
    ("FASTENER", "NUT,HEX,M20,GR8,HDG", dict(fastener_type="HEX_NUT", thread="M20X2.5", grade="PC8")),
    ("FASTENER", "Hex Bolt M12x50 SS316", dict(grade="SS316", length_mm=50)),
    ("FASTENER", "BOLT HEX M12 X 50MM A2-70", dict(grade="SS304")),
    ("PUMP", "PUMP,CENT,50M3/HR,40MHD,7.5KW,FLP",
     dict(pump_type="CENTRIFUGAL", flow_m3h=50, head_m=40, motor_kw=7.5, motor_enclosure="FLP")),
    ("PUMP", "PUMP, CENTRIFUGAL, 50 M3/H, 40 M HEAD, 7.5 KW FLAMEPROOF MOTOR, MOC CI, IS 5120",
     dict(moc="CI", design_standard="IS 5120")),
    ("PUMP", "Centrifugal Pump 833 LPM 40m Head 10HP TEFC CI",
     dict(flow_m3h=49.98, head_m=40, motor_kw=7.46, motor_enclosure="TEFC")),
    ("PUMP", "DEWATERING PUMP SUBMERSIBLE 100M3/HR 50M HEAD 22KW SAFE AREA MOC CI",
     dict(pump_type="SUBMERSIBLE", flow_m3h=100, head_m=50, motor_enclosure="TEFC")),
    ("PUMP", "CENTRIFUGAL PUMP SET Q=50 M3/H H=40 M 7.5KW FLP CI IS 5120",
     dict(flow_m3h=50, head_m=40, motor_enclosure="FLP")),
    ("PUMP", "PUMP,CENT,25M3/HR,32MHD,5.5KW,TEFC", dict(flow_m3h=25, head_m=32, motor_kw=5.5)),
    ("PUMP", "PUMP CENTRIFUGAL API 610 150 M3/H 80 M HEAD 55KW CARBON STEEL FLP",
     dict(design_standard="API 610", moc="CS", motor_kw=55)),
    ("PUMP", "Centrifugal pump 220 USGPM 131 ft head 15HP SS316", dict(flow_m3h=49.96, head_m=39.9, moc="SS316")),
    ("PUMP", "PUMP END SUCTION 10 M3/H 20 M HEAD 1.5 KW 2900 RPM", dict(pump_type="CENTRIFUGAL", speed_rpm=2900)),
    ("PUMP", "SUBMERSIBLE PUMP 200 M3/H 60 M HEAD 45 KW IS 8034 MAKE KSB",
     dict(design_standard="IS 8034", manufacturer="KSB")),
]


def test_attribute_facts(spark):
    rows = [(str(i), "o", str(i), c[1], None, "EA", None, None, None) for i, c in enumerate(CASES)]
    got = {int(r["record_id"]): r for r in process_records(spark.createDataFrame(rows, SCHEMA)).select(
        "record_id", "category", "attributes", "normalized").collect()}
    wrong = []
    for i, (family, text, facts) in enumerate(CASES):
        attrs = values(got[i]["attributes"])
        if got[i]["category"] != family:
            wrong.append((text, "category", family, got[i]["category"]))
        wrong += [(text, k, v, attrs.get(k)) for k, v in facts.items() if attrs.get(k) != v]
    assert not wrong, wrong


def test_classifier(spark):
    from partweave.operators.classify import classify
    cases = [
        ("BEARING DEEP GROOVE BALL 6205", "BEARING"), ("DEEP GROOVE BALL BEARING 6206-2RS1/C3", "BEARING"),
        ('VALVE GATE 4" 150#', "VALVE"), ("CABLE 1.1KV A2XFY 3.5CX95", "CABLE"),
        ("HEX HEAD BOLT M16 X 80", "FASTENER"), ("PUMP CENTRIFUGAL 50 M3/H", "PUMP"),
        ("BEARING FOR CONVEYOR PULLEY", "BEARING"), ("IMPELLER FOR PUMP KSB", "UNCLASSIFIED"),
        ("BEARING HOUSING SN 510", "UNCLASSIFIED"), ('GASKET SPIRAL WOUND 4" 150# SS316', "UNCLASSIFIED"),
        ('VALVE SPINDLE FOR 4" GATE VALVE', "UNCLASSIFIED"), ("MISC ITEM", "UNCLASSIFIED"),
    ]
    df = spark.createDataFrame(cases, "t string, want string").withColumn("c", classify(F.col("t")))
    rows = df.collect()
    assert not [(r.t, r.want, r.c.category) for r in rows if r.want != r.c.category]
    by = {r.t: r.c for r in rows}
    assert by["BEARING HOUSING SN 510"].confidence == 0.85
    assert by["MISC ITEM"].confidence == 0.2
    assert by["BEARING FOR CONVEYOR PULLEY"].reasons[0].startswith('context after "FOR" ignored: "FOR CONVEYOR')
    assert by["BEARING DEEP GROOVE BALL 6205"].scores["BEARING"] == 8.0


def test_flags_and_quality(spark):
    rows = [("1", "o", "1", "VLV,GT,4\"", None, None, None, None, None),
            ("2", "o", "2", "x" * 40, None, "ABC", "SKF", "P1", None)]
    got = {r.record_id: r for r in process_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["1"].flags == ["UOM_MISSING", "MANUFACTURER_MISSING", "PART_NUMBER_MISSING", "ABBREVIATIONS_EXPANDED:2",
                              "MISSING_REQUIRED:PRESSURE_CLASS", "MISSING_REQUIRED:BODY_MATERIAL"]
    assert got["1"].fingerprint is None and got["1"].block_key == "VALVE|GATE|100"
    assert got["2"].flags == ["UOM_UNRECOGNISED", "SHORT_TEXT_TRUNCATED_40", "UNCLASSIFIED"]
