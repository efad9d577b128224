"""The feature table of the risk model: what was known of a unit when it reached a station, and its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.operators.tracing import bands, z_scores


def category_codes(units: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `<column>_code`: the place, from 0, of a value among the column's different values in order; -1 for null.

    The values of a category are a dimension; their codes are made from the distinct ones and come back by a join that Spark may broadcast.
    """
    for c in columns:
        values = units.select(F.col(c).alias("__v")).filter("__v IS NOT NULL").distinct().groupBy().agg(F.array_sort(F.collect_list("__v")).alias("all"))
        codes = values.select(F.posexplode("all").alias("__code", "__v"))
        units = units.join(codes, F.col(c) == F.col("__v"), "left").withColumn(f"{c}_code", F.coalesce("__code", F.lit(-1))).drop("__code", "__v")
    return units


def gate_flags(units: DataFrame, findings: DataFrame, gates: dict[str, int], cutoff: int) -> DataFrame:
    """(unit, gate_<name>...): 1 where a gate before station `cutoff` found something on the unit; findings is (unit, gate), gates name to station."""
    before = [g for g, j in gates.items() if j < cutoff]
    hits = findings.filter(F.col("gate").isin(before)) if before else findings.limit(0)
    wide = hits.groupBy("unit").agg(F.lit(1).alias("__any"), *(F.max((F.col("gate") == g).cast("int")).alias(f"gate_{g}") for g in before))
    return units.select("unit").join(wide, "unit", "left").select("unit", *(F.coalesce(f"gate_{g}", F.lit(0)).alias(f"gate_{g}") for g in before))


def labels(units: DataFrame, findings: DataFrame, gate: str, defect_type: str | None = None) -> DataFrame:
    """(unit, y): 1 where the gate found a defect, of the type if one is given; findings is (unit, gate, defect_type)."""
    hits = findings.filter(F.col("gate") == gate)
    hits = hits if defect_type is None else hits.filter(F.col("defect_type") == defect_type)
    return units.select("unit").join(hits.select("unit", F.lit(1).alias("__y")).distinct(), "unit", "left").select("unit", F.coalesce("__y", F.lit(0)).alias("y"))


def build(
    units: DataFrame, states: DataFrame, signals: DataFrame, stations: list[dict], findings: DataFrame, gates: dict[str, int], categories: list[str],
    upto_station: int, baseline_units: int = 2400,
) -> DataFrame:
    """A row a unit, from stations up to upto_station only, so that nothing later than the prediction is in it.

    units is (unit, categories), states (unit, j, starved_s, dwell_s, blocked), signals (unit, j, signal, v), stations dicts of j, sid, type,
    instrumented and signals (a list of names). Features: z_<sid>_<signal> against the first baseline_units units; min_ and max_<type>__<signal> over
    the stations of a type; zdwell_<sid> of stations without sensors, with their largest and mean; starved_total_s, blocked_frac,
    line_dwell_total_s; codes of the categories; gate flags. All stations of a unit are one aggregate, however many features,
    so the states move once by unit; their bands are read before.
    """
    live = [s for s in stations if s["j"] <= upto_station]
    near = [s["j"] for s in live]
    z = z_scores(signals.filter(F.col("j").isin(near) & (F.col("signal") != "cycle_time_s")), ["j", "signal"], baseline_units)
    pools: dict[str, list[tuple[int, str]]] = {}
    columns = []
    for s in live:
        for name in s["signals"]:
            if name != "cycle_time_s":
                columns.append(F.max(F.when((F.col("j") == s["j"]) & (F.col("signal") == name), F.col("z"))).alias(f"z_{s['sid']}_{name}"))
                pools.setdefault(f"{s['type']}__{name}", []).append((s["j"], name))
    for key, members in pools.items():
        of = F.when(F.struct("j", "signal").isin([F.struct(F.lit(j).alias("j"), F.lit(n).alias("signal")) for j, n in members]), F.col("z"))
        columns += [F.min(of).alias(f"min_{key}"), F.max(of).alias(f"max_{key}")]
    out = units.join(z.groupBy("unit").agg(*columns), "unit", "left") if columns else units
    dark = [s for s in live if not s["instrumented"]]
    seen = states.filter(F.col("j").isin(near))
    columns = []
    if dark:  # other stations have no band, so their z is null and drops out of the aggregates
        band = bands(states.filter(F.col("j").isin([s["j"] for s in dark])).select("unit", "j", F.col("dwell_s").alias("v")), ["j"], baseline_units)
        seen = seen.join(F.broadcast(band), "j", "left").withColumn("z", (F.col("dwell_s") - F.col("mu")) / F.col("sd"))
        columns = [F.max(F.when(F.col("j") == s["j"], F.col("z"))).alias(f"zdwell_{s['sid']}") for s in dark]
        columns += [F.max("z").alias("dark_zdwell_max"), F.avg("z").alias("dark_zdwell_mean")]
    columns += [F.sum("starved_s").alias("starved_total_s"), F.avg(F.col("blocked").cast("double")).alias("blocked_frac"), F.sum("dwell_s").alias("line_dwell_total_s")]
    context = seen.groupBy("unit").agg(*columns)
    out = category_codes(out.join(context, "unit", "left"), categories).drop(*categories)
    return out.join(gate_flags(units, findings, gates, upto_station), "unit")
