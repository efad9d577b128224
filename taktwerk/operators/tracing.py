"""Root causes end to end: what each unit was exposed to, and the ranked hypotheses for one defect at one gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.ranks import quantiles
from taktwerk.operators.causes import benjamini_hochberg, contingency, fisher, ranked

ENVIRONMENT = ("humidity", "booth_temp", "zone_temp")


def bands(values: DataFrame, by: list[str], baseline_units: int) -> DataFrame:
    """(by, mu, sd): the mean and deviation of v over the first units; a row for each station and signal, null where there are none."""
    early = F.when(F.col("unit") < baseline_units, F.col("v"))
    return values.groupBy(*by).agg(F.avg(early).alias("mu"), (F.stddev_pop(early) + 1e-9).alias("sd"))


def z_scores(values: DataFrame, by: list[str], baseline_units: int) -> DataFrame:
    """Adds z of v against the mean and deviation of its key over the first units; null where there are none."""
    return values.join(F.broadcast(bands(values, by, baseline_units)), by).withColumn("z", (F.col("v") - F.col("mu")) / F.col("sd")).drop("mu", "sd")


def signal_exposures(scored: DataFrame, limit: float = 2.0) -> DataFrame:
    """(kind, label, unit) of units whose signal leaves its band, from (unit, sid, signal, z); label `sid:signal_high` or `_low`."""
    kind = F.when(F.col("signal").isin(*ENVIRONMENT), "ENVIRONMENT").otherwise("STATION_SIGNAL")
    side = F.when(F.col("z") > 0, "_high").otherwise("_low")
    out = scored.filter(F.abs("z") > limit)
    return out.select(kind.alias("kind"), F.concat("sid", F.lit(":"), "signal", side).alias("label"), "unit")


def dwell_exposures(scored: DataFrame, limit: float = 2.0) -> DataFrame:
    """(kind, label, unit) of units that stayed long at a station without sensors, from (unit, sid, z)."""
    return scored.filter(F.col("z") > limit).select(F.lit("STATION_DWELL").alias("kind"), F.concat("sid", F.lit(":dwell_high")).alias("label"), "unit")


def quantile_edges(values: DataFrame, column: str, parts: int) -> DataFrame:
    """(k, edge), k from 0 to parts: the quantiles k / parts, linear between neighbours; no rows without values.

    Approximate quantiles bracket the wanted places, so no task sorts all values.
    """
    return quantiles(values, [], column, [k / parts for k in range(parts + 1)]).select("k", F.col("value").alias("edge"))


def window_exposures(visits: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, unit) of the sub-window in which a unit started at a station, from (unit, sid, start_s) and quantile_edges.

    Sub-window k holds starts from edge k up to, without it, edge k + 1; what starts outside of all is in none.
    """
    row = edges.agg(F.sort_array(F.collect_list(F.struct("k", "edge"))).alias("e"))  # parts + 1 numbers
    at = visits.crossJoin(F.broadcast(row.select(F.col("e.edge").alias("edges"))))
    k = F.size(F.filter("edges", lambda e: e <= F.col("start_s"))) - 1
    at = at.withColumn("k", k).filter((F.col("k") >= 0) & (F.col("k") < F.size("edges") - 1))
    label = F.concat("sid", F.lit(":window_"), F.col("k").cast("string"))
    return at.select(F.lit("STATION_WINDOW").alias("kind"), label.alias("label"), "unit")


def unit_exposures(units: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, label, unit) of each unit's values in some columns, such as lot, operator and shift; nulls expose to nothing."""
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("label")) for kind, c in kinds.items()))
    return units.select(F.explode(pairs).alias("e"), "unit").select("e.kind", "e.label", "unit").filter("label IS NOT NULL")


def trace(exposed: DataFrame, labels: DataFrame, alpha: float = 0.05, top: int = 6) -> DataFrame:
    """The `top` hypotheses for a defect, from (kind, label, unit) and (unit, bad): those of q <= alpha, by confidence, then q.

    Candidates are tested by Fisher's one-sided test and held to a false-discovery rate over all of them. Rates have four
    decimals, lift two, confidence three; n_units and n_defective count the cohort.
    """
    tested = ranked(benjamini_hochberg(fisher(contingency(exposed, labels)), ["kind", "label"]))
    best = tested.filter(F.col("q") <= alpha).orderBy(F.desc("confidence"), "q", "kind", "label").limit(top)
    decimals = {"rate_exposed": 4, "rate_unexposed": 4, "lift": 2, "confidence": 3}
    return best.select(
        "kind", "label", F.col("ne").alias("n_exposed"), F.col("a").alias("n_exp_defective"),
        *(F.round(c, d).alias(c) for c, d in decimals.items()), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"),
        F.col("n").alias("n_units"), F.col("nd").alias("n_defective"),
    )


def cohorts(probes: DataFrame, units: DataFrame, findings: DataFrame) -> DataFrame:
    """(probe, unit, bad): the units of each probe's cohort [now_unit - cohort_units, now_unit), and whether its gate found its defect in them.

    probes is (probe, gate, defect_type, now_unit, cohort_units), units (unit), findings (unit, gate, defect_type). Units meet probes by their
    number, so the probes' cohorts are all that is joined.
    """
    from_unit = F.greatest(F.col("now_unit") - F.col("cohort_units"), F.lit(0))
    span = probes.filter(F.col("now_unit") > from_unit).select("probe", "gate", "defect_type", F.explode(F.sequence(from_unit, F.col("now_unit") - 1)).alias("unit"))
    found = findings.select("unit", "gate", "defect_type").distinct().withColumn("__bad", F.lit(1))
    rows = span.join(units.select("unit").distinct(), "unit").join(found, ["unit", "gate", "defect_type"], "left")
    return rows.select("probe", "unit", F.coalesce("__bad", F.lit(0)).alias("bad"))


def trace_probes(exposed: DataFrame, cohort: DataFrame, alpha: float = 0.05, top: int = 6, least_defects: int = 8) -> tuple[DataFrame, DataFrame]:
    """The traces of many probes in one job: (hypotheses, summary), from exposed (kind, label, unit) and cohorts().

    hypotheses has the `top` of each probe with q <= alpha, ranked by confidence, then q (column r). summary has a row a probe: n_units,
    n_findings, n_candidates, n_significant and status: `insufficient_findings` with fewer than least_defects, which are not
    tested, `no_candidate` where nothing exposed fails more often, `no_hypothesis` where nothing is significant, else `traced`.
    """
    totals = cohort.groupBy("probe").agg(F.count("*").alias("n_units"), F.sum("bad").alias("n_findings"))
    enough = totals.filter(F.col("n_findings") >= least_defects).select("probe")
    rows = cohort.join(enough, "probe")
    seen = exposed.join(rows.select("probe", "unit"), "unit").select("probe", "kind", "label", "unit")
    tested = ranked(benjamini_hochberg(fisher(contingency(seen, rows, by=("probe",))), ["kind", "label"], ("probe",)))
    good = tested.filter(F.col("q") <= alpha)
    order = Window.partitionBy("probe").orderBy(F.desc("confidence"), "q", "kind", "label")  # a probe's significant candidates
    best = good.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    counts = tested.groupBy("probe").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("q") <= alpha).alias("n_significant"))
    summary = totals.join(counts, "probe", "left").na.fill(0, ["n_candidates", "n_significant"])
    status = F.when(F.col("n_findings") < least_defects, "insufficient_findings").when(F.col("n_candidates") == 0, "no_candidate").when(F.col("n_significant") == 0, "no_hypothesis")
    return best, summary.withColumn("status", F.coalesce(status, F.lit("traced")))


def score_probes(probes: DataFrame, best: DataFrame, summary: DataFrame) -> DataFrame:
    """(probe, status, n_findings, n_candidates, n_significant, rank1_kind, rank1_label, rank1_lift, rank1_confidence, correct, in_top3).

    probes has `expected`, an array of parts of labels. A trace is correct if its first label holds one of them; a probe that expects nothing
    is a negative control, correct if no hypothesis is returned.
    """
    said = best.join(probes.select("probe", "expected"), "probe").withColumn("hit", F.exists("expected", lambda e: F.contains(F.col("label"), e)))
    first = said.groupBy("probe").agg(
        *(F.max(F.when(F.col("r") == 1, F.col(c))).alias(f"rank1_{c}") for c in ("kind", "label", "lift", "confidence", "hit")),
        F.max(F.when(F.col("r") <= 3, F.col("hit"))).alias("top3"),
    )
    out = probes.select("probe", "expected").join(summary, "probe", "left").join(first, "probe", "left")
    negative = F.size("expected") == 0
    correct = F.when(negative, F.col("rank1_label").isNull()).otherwise(F.coalesce("rank1_hit", F.lit(False)))
    top3 = F.when(negative, F.col("rank1_label").isNull()).otherwise(F.coalesce("top3", F.lit(False)))
    return out.select(
        "probe", F.coalesce("status", F.lit("insufficient_findings")).alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_findings", "n_candidates", "n_significant")),
        "rank1_kind", "rank1_label", "rank1_lift", "rank1_confidence", correct.alias("correct"), top3.alias("in_top3"),
    )
