"""Production lines as data: station types, station layouts, gates and injected faults, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type, nominal cycle (s), its coefficient of variation, defect sensitivity, defect type, cost to equip one
# dark station (INR), signals of a station with sensors.
STATION_TYPES = [
    ("weld_robot", 46.0, 0.06, 0.03, "WELD_POROSITY", 310000, ["cycle_time_s", "weld_current_a", "servo_load_pct"]),
    ("torque_station", 52.0, 0.08, 0.04, "LOOSE_FASTENER", 185000, ["cycle_time_s", "torque_nm", "angle_deg"]),
    ("manual_fit", 53.0, 0.16, 0.012, "FIT_MISALIGN", 95000, ["cycle_time_s"]),
    ("sealer", 50.0, 0.09, 0.018, "SEALANT_VOID", 240000, ["cycle_time_s", "flow_rate_mlps", "nozzle_pressure_bar"]),
    ("paint_booth", 58.0, 0.07, 0.035, "PAINT_FINISH", 420000, ["cycle_time_s", "booth_temp_c", "booth_humidity_pct", "flow_rate_mlps"]),
    ("oven", 56.0, 0.03, 0.01, "PAINT_FINISH", 265000, ["cycle_time_s", "zone_temp_c"]),
    ("electrical_fit", 55.0, 0.11, 0.028, "ELECTRICAL_FAULT", 205000, ["cycle_time_s", "insertion_force_n", "continuity_ohm"]),
    ("inspection_gate", 41.0, 0.12, 0.0, None, 120000, ["cycle_time_s"]),
]

# The stations in order: type, zone, whether they have sensors, cycle scale.
ALPHA_STATIONS = [
    ("weld_robot", "BODY", True, 1.00),
    ("weld_robot", "BODY", True, 1.05),
    ("manual_fit", "BODY", False, 0.98),
    ("weld_robot", "BODY", True, 1.02),
    ("sealer", "BODY", True, 1.00),
    ("manual_fit", "BODY", False, 1.00),
    ("weld_robot", "BODY", True, 1.10),
    ("torque_station", "BODY", True, 0.97),
    ("manual_fit", "BODY", False, 1.01),
    ("weld_robot", "BODY", True, 1.03),
    ("sealer", "BODY", False, 1.00),
    ("torque_station", "BODY", True, 1.04),
    ("manual_fit", "BODY", False, 1.02),
    ("inspection_gate", "BODY", True, 1.00),
    ("paint_booth", "PAINT", True, 1.00),
    ("paint_booth", "PAINT", True, 1.00),
    ("oven", "PAINT", True, 1.03),
    ("manual_fit", "PAINT", False, 0.95),
    ("paint_booth", "PAINT", True, 1.00),
    ("oven", "PAINT", True, 1.01),
    ("manual_fit", "PAINT", False, 1.00),
    ("paint_booth", "PAINT", True, 0.99),
    ("oven", "PAINT", True, 1.00),
    ("inspection_gate", "PAINT", True, 1.00),
    ("manual_fit", "FINAL", False, 1.00),
    ("electrical_fit", "FINAL", True, 1.00),
    ("torque_station", "FINAL", True, 1.01),
    ("manual_fit", "FINAL", False, 1.04),
    ("electrical_fit", "FINAL", True, 0.98),
    ("torque_station", "FINAL", True, 1.03),
    ("manual_fit", "FINAL", False, 0.98),
    ("sealer", "FINAL", True, 1.02),
    ("electrical_fit", "FINAL", True, 1.05),
    ("torque_station", "FINAL", True, 0.99),
    ("manual_fit", "FINAL", False, 1.03),
    ("electrical_fit", "FINAL", True, 1.00),
    ("torque_station", "FINAL", True, 1.02),
    ("manual_fit", "FINAL", False, 0.96),
    ("sealer", "FINAL", True, 1.01),
    ("electrical_fit", "FINAL", True, 1.03),
    ("manual_fit", "FINAL", False, 1.00),
    ("inspection_gate", "FINAL", True, 1.15),
]
BETA_STATIONS = [
    ("weld_robot", "BODY", True, 1.00),
    ("manual_fit", "BODY", False, 1.04),
    ("weld_robot", "BODY", True, 1.06),
    ("manual_fit", "BODY", False, 1.02),
    ("sealer", "BODY", False, 1.00),
    ("torque_station", "BODY", True, 1.02),
    ("manual_fit", "BODY", False, 1.08),
    ("weld_robot", "BODY", True, 1.01),
    ("manual_fit", "BODY", False, 1.00),
    ("inspection_gate", "BODY", True, 1.00),
    ("manual_fit", "FINAL", False, 1.03),
    ("electrical_fit", "FINAL", True, 1.02),
    ("torque_station", "FINAL", True, 1.00),
    ("manual_fit", "FINAL", False, 1.10),
    ("electrical_fit", "FINAL", True, 0.99),
    ("manual_fit", "FINAL", False, 1.01),
    ("torque_station", "FINAL", True, 1.05),
    ("sealer", "FINAL", True, 1.02),
    ("manual_fit", "FINAL", False, 1.00),
    ("electrical_fit", "FINAL", True, 1.07),
    ("torque_station", "FINAL", True, 1.01),
    ("manual_fit", "FINAL", False, 0.98),
    ("sealer", "FINAL", True, 1.00),
    ("electrical_fit", "FINAL", True, 1.03),
    ("manual_fit", "FINAL", False, 1.02),
    ("torque_station", "FINAL", True, 0.99),
    ("manual_fit", "FINAL", False, 1.05),
    ("inspection_gate", "FINAL", True, 1.12),
]

# What each gate inspects, and the chance that it sees a defect.
GATES = {
    "S14": (0.55, ["WELD_POROSITY", "SEALANT_VOID"]),
    "S24": (0.62, ["PAINT_FINISH"]),
    "S42": (0.86, ["WELD_POROSITY", "SEALANT_VOID", "PAINT_FINISH", "LOOSE_FASTENER", "ELECTRICAL_FAULT", "FIT_MISALIGN"]),
    "B10": (0.52, ["WELD_POROSITY", "SEALANT_VOID"]),
    "B28": (0.84, ["WELD_POROSITY", "SEALANT_VOID", "LOOSE_FASTENER", "ELECTRICAL_FAULT", "FIT_MISALIGN"]),
}

# Takt (s), shift (h), shifts a day, days, seed, units a lot, operators a zone; then buffers by zone, transport and the exceptions.
LINES = {
    "alpha": {"takt_s": 60.0, "shift_hours": 8.0, "shifts_per_day": 2, "days": 20, "seed": 7, "lot_size_units": 420, "operators_per_zone": 4},
    "beta": {"takt_s": 72.0, "shift_hours": 8.0, "shifts_per_day": 1, "days": 20, "seed": 11, "lot_size_units": 300, "operators_per_zone": 4},
}
LAYOUTS = {
    "alpha": {"prefix": "S", "stations": ALPHA_STATIONS, "final_buffer": 1, "transport": (3.2, 2.6, 37, 11), "parallel": {"S04": 2, "S10": 2}, "rework": {"S14": (0.075, 38.0)}},
    "beta": {"prefix": "B", "stations": BETA_STATIONS, "final_buffer": 2, "transport": (3.6, 2.2, 29, 9), "parallel": {}, "rework": {}},
}

# Fault, kind, target, first and last day, magnitude, defect type.
FAULTS = {
    "alpha": [
        ("F1", "PARAM_DRIFT", "S12", 9.0, 20.0, 0.3, "LOOSE_FASTENER"),
        ("F2", "CYCLE_DEGRADE", "S28", 6.0, 20.0, 0.0075, None),
        ("F3", "LOT_CONTAM", "LOT-425", 0.0, 99.0, 6.2, "ELECTRICAL_FAULT"),
        ("F4", "ENV_EXCURSION", "PAINT", 15.0, 16.6, 14.0, "PAINT_FINISH"),
        ("F6", "OPERATOR_VAR", "FINAL-OP2", 0.0, 99.0, 1.55, "FIT_MISALIGN"),
        ("F5", "MICROSTOP", "S07", 3.0, 20.0, 0.011, None),
    ],
    "beta": [
        ("F1", "PARAM_DRIFT", "B17", 8.0, 20.0, 0.32, "LOOSE_FASTENER"),
        ("F2", "CYCLE_DEGRADE", "B14", 5.0, 20.0, 0.008, None),
        ("F3", "LOT_CONTAM", "LOT-418", 0.0, 99.0, 5.8, "ELECTRICAL_FAULT"),
        ("F6", "OPERATOR_VAR", "FINAL-OP2", 0.0, 99.0, 1.55, "FIT_MISALIGN"),
        ("F5", "MICROSTOP", "B03", 3.0, 20.0, 0.012, None),
    ],
    "adversarial": [
        ("A1", "STEP", "S30", 11.0, 20.0, 2.6, "LOOSE_FASTENER"),
        ("A2", "OSCILLATE", "S19", 4.0, 20.0, 0.055, None),
        ("A3", "BURST", "S36", 7.0, 20.0, 0.16, None),
    ],
}

STATION_SCHEMA = """line string, sid string, type_name string, zone string, station_idx int, buffer_capacity int, instrumented boolean,
  cycle_scale double, transport_s double, parallel int, rework_rate double, rework_minutes double, inspects array<string>, detect_prob double"""


def station_types(spark: SparkSession) -> DataFrame:
    """type_name, nominal_cycle_s, cycle_cv, defect_sensitivity, defect_type (null for gates), retrofit_cost_inr, signals."""
    schema = "type_name string, nominal_cycle_s double, cycle_cv double, defect_sensitivity double, defect_type string, retrofit_cost_inr long, signals array<string>"
    return spark.createDataFrame(STATION_TYPES, schema)


def stations(spark: SparkSession, line: str) -> DataFrame:
    """The stations of a line, one row each (STATION_SCHEMA), numbered from 1."""
    layout = LAYOUTS[line]
    low, span, step, ring = layout["transport"]
    rows = []
    for i, (kind, zone, sensors, scale) in enumerate(layout["stations"], 1):
        sid = f"{layout['prefix']}{i:02d}"
        seen, inspects = GATES.get(sid, (0.0, []))
        rate, minutes = layout["rework"].get(sid, (0.0, 0.0))
        buffer = 5 if kind == "oven" else layout["final_buffer"] if zone == "FINAL" else 3
        place = (line, sid, kind, zone, i, buffer, sensors, scale, round(low + span * (i * step % ring) / 10, 2))
        rows.append((*place, layout["parallel"].get(sid, 1), rate, minutes, inspects, seen))
    return spark.createDataFrame(rows, STATION_SCHEMA)


def faults(spark: SparkSession, name: str) -> DataFrame:
    """fault_id, kind, target, start_day, end_day, magnitude and defect_type (may be null) of a set of faults."""
    return spark.createDataFrame(
        FAULTS[name], "fault_id string, kind string, target string, start_day double, end_day double, magnitude double, defect_type string"
    )


def described(stations: DataFrame, types: DataFrame) -> DataFrame:
    """The stations with their own nominal cycle, the signals that they show (none if dark) and the type's defect and cost."""
    shown = F.when(F.col("instrumented"), F.col("signals")).otherwise(F.array().cast("array<string>"))
    out = stations.join(F.broadcast(types), "type_name").withColumn("observed_signals", shown)
    return out.withColumn("nominal_cycle_s", F.col("nominal_cycle_s") * F.col("cycle_scale")).drop("signals")


def coverage(stations: DataFrame) -> DataFrame:
    """Of each line: n_stations, n_dark, coverage (the share with sensors), has_rework and has_parallel."""
    return stations.groupBy("line").agg(
        F.count("*").alias("n_stations"),
        F.count_if(~F.col("instrumented")).alias("n_dark"),
        F.avg(F.col("instrumented").cast("double")).alias("coverage"),
        F.bool_or(F.col("rework_rate") > 0).alias("has_rework"),
        F.bool_or(F.col("parallel") > 1).alias("has_parallel"),
    )


def coverage_after(stations: DataFrame, chosen: DataFrame) -> DataFrame:
    """(line, coverage) once the dark stations in `chosen` (sid) have sensors too."""
    new = stations.join(F.broadcast(chosen.select(F.col("sid").alias("__sid")).distinct()), F.col("sid") == F.col("__sid"), "left")
    return new.groupBy("line").agg(F.avg((F.col("instrumented") | F.col("__sid").isNotNull()).cast("double")).alias("coverage"))


def observable(view: DataFrame, stations: DataFrame, hidden: list[str]) -> DataFrame:
    """What the twin may see of a view with a column sid: the columns that aren't `hidden` truth, of stations with sensors only."""
    lit = stations.filter("instrumented").select("sid").distinct()
    return view.drop(*hidden).join(F.broadcast(lit), "sid", "left_semi")  # a row a station


def affected(stations: DataFrame, faults: DataFrame) -> DataFrame:
    """(line, fault_id, sid): every station that a fault moves, not only the one that it names.

    A named station; else the zone of an excursion of the surroundings, the manual stations in an operator's zone, or the
    electrical stations that fit a bad lot. One union of equi-joins, so nothing is compared pair by pair.
    """
    named = stations.join(faults, F.col("sid") == F.col("target"))
    other = faults.join(stations.select(F.col("sid").alias("target")), "target", "left_anti")
    air = stations.join(other.filter("kind = 'ENV_EXCURSION'"), F.col("zone") == F.col("target"))
    person = other.filter("kind = 'OPERATOR_VAR'").withColumn("of", F.split("target", "-")[0])
    hands = stations.filter("type_name = 'manual_fit'").join(person, F.col("zone") == F.col("of"))
    wired = stations.filter("type_name = 'electrical_fit'").withColumn("hit_by", F.lit("LOT_CONTAM"))
    lot = wired.join(other, F.col("hit_by") == F.col("kind"))
    parts = [x.select("line", "fault_id", "sid") for x in (named, air, hands, lot)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def gate_map(stations: DataFrame) -> DataFrame:
    """(line, defect_type, gate, cutoff): the first gate that inspects for each defect type; cutoff counts the stations before it."""
    each = stations.select("line", "sid", "station_idx", F.explode("inspects").alias("defect_type"))
    first = each.groupBy("line", "defect_type").agg(F.min_by("sid", "station_idx").alias("gate"), F.min("station_idx").alias("idx"))
    return first.select("line", "defect_type", "gate", (F.col("idx") - 1).alias("cutoff"))


def inr(amount: Column) -> Column:
    """An amount in crore from 1e7 on, in lakh from 1e5 on, else in rupees."""
    size = F.abs(amount)
    return (
        F.when(size >= 1e7, F.concat(F.round(amount / 1e7, 2).cast("string"), F.lit(" cr")))
        .when(size >= 1e5, F.concat(F.round(amount / 1e5, 2).cast("string"), F.lit(" L")))
        .otherwise(F.concat(F.lit("Rs "), F.round(amount).cast("long").cast("string")))
    )


def write_config(stations: DataFrame, types: DataFrame, path: str) -> None:
    """The described stations as JSON lines, nulls kept."""
    described(stations, types).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
