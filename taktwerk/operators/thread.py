"""Questions to the digital thread, many at once: who was at a station between two moments, and where those units are now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 4096  # unit numbers in a part of a question's units


def overlaps(visits: DataFrame, questions: DataFrame, bucket_s: float = 600.0, keep: tuple[str, ...] = (), told: tuple[str, ...] = ()) -> DataFrame:
    """(question, unit, j, start_s, depart_s): the visits to a question's station with depart_s > t0 and start_s < t1.

    visits is (unit, j, start_s, depart_s), questions (question, j, t0, t1), a row each, however many. Both fall into the buckets of time that
    they touch and meet by station and bucket, so no nested loop compares them; a pair that shares several buckets counts in the first
    of them. A question of no length has no visits. keep and told: columns of visits and of questions that come along.
    """

    def first(lo: str) -> Column:
        return F.floor(F.col(lo) / bucket_s).cast("long")

    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(first(lo), F.greatest(first(lo), first(hi)))))

    v = spread(visits.select("unit", "j", "start_s", "depart_s", *keep).filter("start_s <= depart_s"), "start_s", "depart_s")
    q = spread(questions.select("question", "j", "t0", "t1", *told).filter("t0 < t1"), "t0", "t1")
    met = v.join(q, ["j", "bucket"]).filter((F.col("bucket") == F.greatest(first("start_s"), first("t0"))) & (F.col("depart_s") > F.col("t0")) & (F.col("start_s") < F.col("t1")))
    return met.select("question", "unit", "j", "start_s", "depart_s", *keep, *told)


def suspects(exposed: DataFrame, spans: DataFrame | None, now: DataFrame | None, listed: int = 200) -> DataFrame:
    """(question, n_exposed, n_in_line, n_shipped, units): the units of each question, split by whether they had left the line by its now_s.

    exposed is (question, unit), spans (unit, gone_s), now (question, now_s); spans or now may be None where exposed has gone_s or now_s already,
    which saves moving its pairs for a join. units lists the first `listed` in the line. A question's units move once, in parts of PART unit
    numbers, so no task orders them all; a row or a few for each question put the parts together. A question without units has no row.
    """
    units = exposed if spans is None else exposed.join(spans.select("unit", "gone_s"), "unit")
    units = units if now is None else units.join(now.select("question", "now_s"), "question")
    units = units.select("question", F.floor(F.col("unit") / PART).alias("part"), "unit", (F.col("gone_s") > F.col("now_s")).alias("here"))
    tasks = int(exposed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small rows aren't put together into tasks that spill
    units = units.repartition(tasks, "question", "part").distinct()
    parts = units.groupBy("question", "part").agg(
        F.count("*").alias("n_exposed"), F.count_if("here").alias("n_in_line"), F.count_if(~F.col("here")).alias("n_shipped"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("here"), F.col("unit")))), 1, listed).alias("units"),
    )
    counts = (F.sum(n).alias(n) for n in ("n_exposed", "n_in_line", "n_shipped"))
    return parts.groupBy("question").agg(*counts, F.slice(F.array_sort(F.flatten(F.collect_list("units"))), 1, listed).alias("units"))


def thread(units: DataFrame, visits: DataFrame, signals: DataFrame) -> DataFrame:
    """(unit, j, start_s, depart_s, signals): every station of the asked units, with a map of the signals taken there.

    signals is (unit, j, name, value). The asked units are joined first, so only their rows are gathered.
    """
    asked = units.select("unit").distinct()
    own = signals.join(asked, "unit", "left_semi").groupBy("unit", "j").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("signals"))
    rows = visits.join(asked, "unit", "left_semi").join(own, ["unit", "j"], "left")
    return rows.select("unit", "j", "start_s", "depart_s", F.coalesce("signals", F.create_map().cast("map<string,double>")).alias("signals"))


def neighbourhood(units: DataFrame, attributes: dict[str, tuple[str, str]], visits: DataFrame) -> DataFrame:
    """(unit, src, relation, dst): the edges around units: to the values of their attributes, and from their visits to stations.

    attributes: from column to (relation, prefix of the node); nulls have no edge. visits is (unit, sid).
    """
    edges = F.array(*(F.struct(F.lit("Unit").alias("src"), F.lit(rel).alias("relation"), F.concat(F.lit(prefix), F.col(c).cast("string")).alias("dst")) for c, (rel, prefix) in attributes.items()))
    own = units.select("unit", F.explode(edges).alias("e")).select("unit", "e.*").filter("dst IS NOT NULL")
    at = visits.join(units.select("unit").distinct(), "unit", "left_semi").select("unit", F.lit("Visit").alias("src"), F.lit("AT").alias("relation"), F.col("sid").alias("dst"))
    return own.union(at)


def edge_counts(units: DataFrame, visits: DataFrame, stations: DataFrame, findings: DataFrame) -> DataFrame:
    """(src, relation, dst, n_edges): each kind of edge of the thread's graph and how many of them the tables hold.

    units is (unit, lot, shift), visits (unit, sid, operator, n_signals), stations (zone, type_name), findings (unit, gate, defect_type). A null end
    has no edge; an empty table has none of its kinds, which stay with 0. Each table is read once, for one row of counts.
    """

    def tally(df: DataFrame, kinds: dict[tuple[str, str, str], Column]) -> DataFrame:
        row = df.agg(*(F.coalesce(n, F.lit(0)).cast("long").alias(f"n{i}") for i, n in enumerate(kinds.values())))
        edges = (F.struct(F.lit(src).alias("src"), F.lit(rel).alias("relation"), F.lit(dst).alias("dst"), F.col(f"n{i}").alias("n_edges")) for i, (src, rel, dst) in enumerate(kinds))
        return row.select(F.inline(F.array(*edges)))

    parts = (
        tally(units, {("Unit", "IN_LOT", "Lot"): F.count("lot"), ("Unit", "IN_SHIFT", "Shift"): F.count("shift")}),
        tally(visits, {("Unit", "HAS_VISIT", "Visit"): F.count("unit"), ("Visit", "AT", "Station"): F.count("sid"), ("Visit", "BY", "Operator"): F.count("operator"),
                       ("Visit", "MEASURED", "Signal"): F.sum("n_signals")}),
        tally(stations, {("Station", "IN_ZONE", "Zone"): F.count("zone"), ("Station", "OF_TYPE", "StationType"): F.count("type_name")}),
        tally(findings, {("Unit", "HAS_FINDING", "Finding"): F.count("unit"), ("Finding", "AT_GATE", "Gate"): F.count("gate"), ("Finding", "OF_DEFECT", "DefectType"): F.count("defect_type")}),
    )
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
