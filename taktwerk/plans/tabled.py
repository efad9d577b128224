"""Registered queries that apply the operators where `tables` has a text; the text, in DuckDB's dialect, is their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.operators import features, feed, investment, risk, tracing
from taktwerk.plans import states
from taktwerk.plans.charts import rounded
from taktwerk.sources import lines, plant, sinks

BASELINE = 2400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, j, v): the mean quantity of an order's line."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("j")).agg(F.avg("l_quantity").alias("v"))


def zed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracing.z_scores(signal(spark, sf_dir), ["j"], BASELINE).drop("v")


def q_type_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zed(spark, sf_dir).groupBy("unit", (F.col("j") % 3).alias("kind")).agg(F.min("z").alias("lo"), F.max("z").alias("hi")))


def q_dark_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zed(spark, sf_dir).filter("j % 2 = 0").groupBy("unit").agg(F.max("z").alias("top"), F.avg("z").alias("mean_z")))


def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = zed(spark, sf_dir).filter("j <= 5").groupBy("unit").pivot("j", [1, 2, 3, 4, 5]).agg(F.max("z"))
    return rounded(wide.withColumnsRenamed({str(k): f"z_s{k}" for k in range(1, 6)}))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, gate, defect_type): a returned line as a finding behind its station."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return rows.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").cast("string").alias("gate"), F.lit("R").alias("defect_type"))


def q_category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = features.category_codes(units(spark, sf_dir), ["priority", "status"])
    return coded.select("unit", "priority_code", "status_code")


def q_gate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = features.gate_flags(units(spark, sf_dir), findings(spark, sf_dir), {"2": 2, "4": 4}, 7)
    return flags.withColumnsRenamed({"gate_2": "gate2", "gate_4": "gate4"})


def q_type_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("l_orderkey") % 100 < 65, "train").when(F.col("l_orderkey") % 100 < 80, "calib").otherwise("test")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("type"), part.alias("part"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    found = rows.groupBy("type").agg(F.sum("y").cast("long").alias("n_pos"))
    return risk.type_status(rows).join(found, "type").select(F.col("type").alias("defect_type"), "n_pos", "status")


def q_rolling_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of each block of 250 units from the four blocks before it, for blocks that have units."""
    rows = states.scored(spark, sf_dir)[0].withColumn("own", F.floor(F.col("unit") / 250))
    seen = rows.withColumn("b", F.explode(F.sequence(F.col("own") + 1, F.col("own") + 4))).join(rows.select(F.col("own").alias("b")).distinct(), "b")
    return rounded(risk.conformal_levels(seen, least=0, by=("b",)).select("b", "y", "n", "q"))


def stations(spark: SparkSession) -> DataFrame:
    rows = [(f"S{j}", j % 2 == 1) for j in range(1, 8)]
    return spark.createDataFrame(rows, "sid string, instrumented boolean")


def q_confidence_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "lineitem").filter("l_linenumber < 5")
    quality = few.groupBy(F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("sid")).agg((1 - F.avg("l_discount")).alias("quality"))
    estimates = stations(spark).select("sid", F.lit(0.9).alias("confidence"))
    return rounded(feed.adjust_confidence(estimates, quality).select("sid", "confidence", "raw"))


def q_observable_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("sid", F.concat(F.lit("S"), F.col("l_linenumber").cast("string")))
    seen = lines.observable(rows, stations(spark), ["l_tax", "l_discount"])
    return rounded(seen.groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("j")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("v")))


def q_feed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = plant.scans(spark, sf_dir)
    none = spark.createDataFrame([], "j int, drift_s double, drifted boolean")
    return rounded(feed.station_quality(scans, none).select("j", "missing_rate", "quality"))


def q_sweep_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    doses = F.explode(F.array(*map(F.lit, (0, 1, 3, 6, 12))))
    rows = plant.scans(spark, sf_dir).select("unit", "j", "proc_s", doses.alias("rate"))
    missed = (F.col("unit") * 37 + F.col("j") * 53) % 100 < F.col("rate")
    return rounded(rows.groupBy("rate", "j").agg(F.count_if(missed).alias("n_missed"), F.avg(F.when(~missed, F.col("proc_s"))).alias("mean_s")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations: the width of an interval from the discounts, confidence from the taxes, slack from the quantities."""
    lines_of = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.avg("l_quantity").alias("mean"), F.count("*").alias("n"), F.avg("l_discount").alias("ci"), F.avg("l_tax").alias("tax")
    )
    rows = table(spark, sf_dir, "supplier").join(lines_of, "s_suppkey")
    return rows.select(
        F.col("s_suppkey").alias("sid"), "mean", "ci", "tax", F.col("ci").alias("share"), (F.col("tax") * 10).alias("confidence"), (F.col("mean") - 25).alias("slack_s"),
        (F.col("n") / 1000).alias("hits"), F.col("tax").alias("expected"), "n", (100_000 + F.abs("s_acctbal") * 10).alias("cost"),
    )


def q_evi_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(investment.information_value(candidates(spark, sf_dir)).select("sid", "uncertainty", "exposure", "ambiguity", "evi", "evi_per_lakh"))


def q_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = investment.information_value(candidates(spark, sf_dir))
    return found.select("sid", investment.rationale(F.col("uncertainty"), F.col("exposure")).alias("rationale"))


def q_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investment.top_overlap(investment.information_value(candidates(spark, sf_dir)), "evi", "evi_per_lakh")


def q_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"l_quantity": "mean_quantity", "l_discount": "mean_discount", "l_tax": "mean_tax"}
    summary = sinks.metric_summary(table(spark, sf_dir, "lineitem").withColumnsRenamed(names), list(names.values()))
    limits = {"mean_quantity": (20, 30), "mean_discount": (0, 0.02), "mean_tax": (0, 0.1)}
    return rounded(sinks.envelope(summary, limits).select("metric", F.col("mean").alias("v"), "ok"))


def q_top_evidence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.q_top_evidence(spark, sf_dir)


def q_repair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.col("x") - F.col("true_s")
    return plant.scans(spark, sf_dir).agg(F.count_if(F.col("x").isNull()).alias("n_missing"), F.count_if(off < 0).alias("n_duplicate"), F.count_if(off > 0).alias("n_late"), F.count("*").alias("n"))


def q_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.element_at(F.array(F.lit("train"), F.lit("calib"), F.lit("test")), F.when(F.col("unit") % 100 >= 80, 3).when(F.col("unit") % 100 >= 65, 2).otherwise(1))
    return units(spark, sf_dir).select("unit", part.alias("part"))


def q_regime_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three days in a row on which clicks lead, as rows by day."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    counts = table(spark, sf_dir, "events").groupBy(day.alias("d"), "event_type").agg(F.count("*").alias("n"))
    top = counts.groupBy("d").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("m"), "event_type")).alias("lead"))
    w = Window.partitionBy(F.lit(0)).orderBy("d")  # a row a day
    held = top.withColumn("held", (F.col("lead") == "click") & (F.lead("lead", 1).over(w) == "click") & (F.lead("lead", 2).over(w) == "click")).withColumn("last", F.lead("d", 2).over(w))
    return held.agg(F.coalesce(F.min(F.when(F.col("held"), F.col("last") - 2)), F.lit(-1)).alias("first_day"), F.count("*").alias("n_days"))


QUERIES = {
    "q_zscores": lambda s, d: rounded(zed(s, d)),
    "q_type_extremes": q_type_extremes,
    "q_dark_z": q_dark_z,
    "q_feature_matrix": q_feature_matrix,
    "q_category_codes": q_category_codes,
    "q_gate_flags": q_gate_flags,
    "q_labels": lambda s, d: features.labels(units(s, d), findings(s, d), "7"),
    "q_type_status": q_type_status,
    "q_rolling_conformal": q_rolling_conformal,
    "q_confidence_adjust": q_confidence_adjust,
    "q_observable_view": q_observable_view,
    "q_feed_quality": q_feed_quality,
    "q_clock_drift": lambda s, d: rounded(feed.clock_drift(plant.scans(s, d), "true_s")),
    "q_sweep_missed": q_sweep_missed,
    "q_evi_rank": q_evi_rank,
    "q_rationale": q_rationale,
    "q_top_overlap": q_top_overlap,
    "q_envelope": q_envelope,
    "q_top_evidence_all": q_top_evidence_all,
    "q_repair_score": q_repair_score,
    "q_time_split": q_time_split,
    "q_regime_lead": q_regime_lead,
}
ORACLES = {
    "q_top_overlap": """WITH c AS (SELECT s_suppkey AS sid, 100000 + abs(s_acctbal) * 10 AS cost, avg(l_quantity) AS q, count(*) AS n, avg(l_discount) AS d, avg(l_tax) AS t
        FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal),
      e AS (SELECT sid, cost, 0.2 * least(greatest(40 * d / q + 1 - t * 10, 0), 2) + 0.2 * least(greatest(d + least(greatest(q - 25, 0) / 5, 1), 0), 2) + 0.2 * least(greatest(n / 5000 + t, 0), 1) AS evi FROM c),
      a AS (SELECT sid FROM e ORDER BY evi DESC, sid LIMIT 5), b AS (SELECT sid FROM e ORDER BY evi / (cost / 100000) DESC, sid LIMIT 5)
      SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM a JOIN b USING (sid))::INT AS overlap,
        (SELECT sid FROM e ORDER BY evi DESC, sid LIMIT 1) = (SELECT sid FROM e ORDER BY evi / (cost / 100000) DESC, sid LIMIT 1) AS top1""",
}
