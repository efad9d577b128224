"""Registered queries of the chart, feed, state and root-cause operators, with independent SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import causes, feed, investment, kernels, spc
from taktwerk.sources import plant


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def block_means(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spc.blocks(events, "event_type", ["ts", "event_id"], "value", size)


BLOCKS = """
seq AS (SELECT event_type AS series, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events),
means AS (SELECT series, (rn // 20)::BIGINT AS blk, avg(value) AS m FROM seq GROUP BY ALL HAVING count(*) = 20),
moved AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY series ORDER BY blk)) AS mr FROM means),
base AS (SELECT series, median(m) FILTER (WHERE blk < 10) AS mu, greatest(median(mr) FILTER (WHERE blk < 10) / 0.954, 1e-9) AS sd
         FROM moved GROUP BY series HAVING count(*) >= 13)"""
CUSUM = f"""{BLOCKS},
z AS (SELECT series, blk, (m - mu) / sd AS z FROM means JOIN base USING (series)),
s AS (SELECT series, blk, sum(z - 0.5) OVER w AS s1, sum(-z - 0.5) OVER w AS s2 FROM z WINDOW w AS (PARTITION BY series ORDER BY blk)),
lows AS (SELECT *, least(0, min(s1) OVER w) AS l1, least(0, min(s2) OVER w) AS l2 FROM s WINDOW w AS (PARTITION BY series ORDER BY blk)),
cusum AS (SELECT series, blk, s1 - l1 AS hi, s2 - l2 AS lo, greatest(s1 - l1, s2 - l2) AS stat,
          coalesce(CASE WHEN s1 - l1 >= s2 - l2 THEN max(CASE WHEN s1 <= l1 THEN blk END) OVER w
                   ELSE max(CASE WHEN s2 <= l2 THEN blk END) OVER w END, 0) AS onset,
          greatest(s1 - l1, s2 - l2) > 9.35 AND blk >= 10 AS flag FROM lows WINDOW w AS (PARTITION BY series ORDER BY blk))"""
EWMA = f"""{BLOCKS},
pairs AS (SELECT a.series, a.blk, sum(0.22 * pow(0.78, a.blk - b.blk) * (b.m - mu)) AS stat, any_value(sd) AS sd
          FROM means a JOIN means b ON a.series = b.series AND b.blk <= a.blk JOIN base ON base.series = a.series GROUP BY ALL),
ewma AS (SELECT series, blk, stat, 5.5 * sd * sqrt(0.22 / 1.78 * (1 - pow(0.78, 2 * (blk + 1)))) AS lim FROM pairs),
flagged AS (SELECT *, abs(stat) > lim AND blk >= 10 AS flag FROM ewma)"""
FEED = plant.PLANT + """,
runs AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY j) AS run FROM scan),
dup AS (SELECT *, CASE WHEN x IS NOT NULL THEN j * 4.5e0 + max(x - j * 4.5e0) OVER (PARTITION BY unit, run ORDER BY j) END AS x_dup FROM runs),
gaps AS (SELECT *, x_dup - lag(x_dup) OVER (PARTITION BY unit ORDER BY j) AS gap FROM dup),
floors AS (SELECT j, quantile_cont(gap, 0.005) AS floor_s FROM gaps WHERE gap IS NOT NULL GROUP BY j HAVING count(*) >= 200),
late AS (SELECT dup.*, CASE WHEN lead(x_dup) OVER w - x_dup < lead(floor_s) OVER w THEN lead(x_dup) OVER w - lead(floor_s) OVER w
                       ELSE x_dup END AS x_late FROM dup LEFT JOIN floors USING (j) WINDOW w AS (PARTITION BY unit ORDER BY j))"""
STATES = plant.PLANT + """,
arrived AS (SELECT unit, j, true_s, coalesce(lag(true_s) OVER (PARTITION BY unit ORDER BY j) + 4.5e0, release_s) AS arrive_s,
            lag(true_s) OVER (PARTITION BY j ORDER BY true_s, unit) AS prev_s FROM scan),
begun AS (SELECT *, greatest(arrive_s, prev_s) AS start_s FROM arrived),
gated AS (SELECT *, lag(start_s) OVER (PARTITION BY j ORDER BY true_s, unit) AS earlier_s FROM begun),
state AS (SELECT unit, j, arrive_s, start_s, true_s - start_s AS dwell_s, coalesce(greatest(start_s - prev_s, 0), 0) AS starved_s,
          lead(earlier_s) OVER (PARTITION BY unit ORDER BY j) - start_s AS theta_s FROM gated)"""
DRIFT = "CASE WHEN j = 5 AND unit >= {half} THEN 8e0 ELSE 0e0 END"  # the reader of station 5 goes late half-way
DIRTY = FEED.replace("runs AS (SELECT *,", f"dirty AS (SELECT * REPLACE (x + {DRIFT.format(half='(SELECT max(unit) / 2 FROM scan)')} AS x) FROM scan),\nruns AS (SELECT *,").replace("FROM scan),\ndup", "FROM dirty),\ndup") + f""",
hop AS (SELECT j, unit >= (SELECT max(unit) / 2 FROM dirty) AS late, x - lag(x) OVER (PARTITION BY unit ORDER BY j) AS gap FROM dirty),
moved AS (SELECT j, median(gap) FILTER (WHERE late) - median(gap) FILTER (WHERE NOT late) AS drift_s FROM hop GROUP BY j
          HAVING count(gap) FILTER (WHERE late) >= 100 AND count(gap) FILTER (WHERE NOT late) >= 100),
graded AS (SELECT j, avg((x IS NULL)::INT) AS missing_rate, any_value(coalesce(drift_s, 0)) AS drift_s, any_value(coalesce(abs(drift_s) > 3, false)) AS drifted
           FROM dirty LEFT JOIN moved USING (j) GROUP BY j),
quality AS (SELECT *, greatest(0, least(1, 1 - 6 * missing_rate)) * CASE WHEN drifted THEN 0.5 ELSE 1 END AS quality FROM graded),
report AS (
  SELECT count(*) FILTER (WHERE x IS NULL) AS n_missing, count(*) FILTER (WHERE abs(x - x_dup) > 1e-9) AS n_duplicates, count(*) FILTER (WHERE abs(x_dup - x_late) > 1e-9) AS n_late,
         (SELECT count(*) FILTER (WHERE drifted) FROM quality) AS n_drifted, (SELECT avg(quality) FROM quality) AS overall_quality FROM late)"""
LABELS = """
labels AS (SELECT o_orderkey AS unit, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS bad FROM orders)"""
EXPOSED = """
exposed AS (
  SELECT 'LOT' AS kind, 'LOT-' || CAST(o_orderkey // 480 AS VARCHAR) AS label, o_orderkey AS unit FROM orders
  UNION ALL SELECT 'OPERATOR', o_orderpriority, o_orderkey FROM orders
  UNION ALL SELECT 'ENVIRONMENT', 'high_total', o_orderkey FROM orders WHERE o_totalprice > 300000
  UNION ALL SELECT 'STATION_SIGNAL', 'S' || CAST(l_linenumber AS VARCHAR), l_orderkey FROM lineitem WHERE l_quantity > 45 GROUP BY ALL)"""
TESTED = """
found AS (SELECT kind, label, count(*) AS ne, sum(bad) AS a FROM exposed JOIN labels USING (unit) GROUP BY ALL),
two AS (SELECT *, a / ne AS rate_exposed, (nd - a) / (n - ne) AS rate_unexposed
        FROM found, (SELECT count(*) AS n, sum(bad) AS nd FROM labels) WHERE ne >= 25 AND n - ne >= 25),
tab AS (SELECT *, rate_exposed / greatest(rate_unexposed, 1e-9) AS lift FROM two WHERE rate_exposed > rate_unexposed),
tail AS (
  SELECT kind, label, unnest(range(a::BIGINT, least(ne, nd)::BIGINT + 1)) AS k, n::BIGINT AS n, nd::BIGINT AS nd, ne::BIGINT AS ne FROM tab),
fisher AS (
  SELECT kind, label, least(1, sum(CASE WHEN n - nd - ne + k < 0 THEN 0 ELSE exp(lgamma(nd + 1) - lgamma(k + 1) - lgamma(nd - k + 1)
         + lgamma(n - nd + 1) - lgamma(ne - k + 1) - lgamma(n - nd - ne + k + 1)
         - lgamma(n + 1) + lgamma(ne + 1) + lgamma(n - ne + 1)) END)) AS p FROM tail GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (ORDER BY p, kind, label) AS r, count(*) OVER () AS m FROM fisher JOIN tab USING (kind, label)),
bh AS (SELECT *, least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ordered)"""
CAUSES = f"{LABELS},{EXPOSED},{TESTED}"
# hypotheses of seven stations: two signals out of band, and six sub-windows
STATION_EXPOSED = """
exposed AS (
  SELECT 'STATION_SIGNAL' AS kind, 'S' || CAST(l_linenumber AS STRING) || ':quantity_high' AS label, l_orderkey AS unit FROM lineitem WHERE l_quantity > 45
  UNION SELECT 'STATION_SIGNAL', 'S' || CAST(l_linenumber AS STRING) || ':price_low', l_orderkey FROM lineitem WHERE l_extendedprice < 20000
  UNION SELECT 'STATION_WINDOW', 'S' || CAST(l_linenumber AS STRING) || ':w' || CAST(l_orderkey % 6 AS STRING), l_orderkey FROM lineitem)"""
ZONE_OF = "CASE WHEN kind = 'STATION_WINDOW' THEN '' WHEN substr(label, 2, 1) <= '3' THEN 'BODY' ELSE 'FINAL' END"
HYPS = f"""{LABELS},{STATION_EXPOSED.replace("STRING", "VARCHAR")},{TESTED},
hyp AS (SELECT *, {ZONE_OF} AS zone, least(1, greatest(0, (1 - q) * tanh((lift - 1) / 2) * least(1, a / 25))) AS confidence FROM bh),
fam AS (SELECT *, CASE WHEN kind = 'STATION_WINDOW' THEN 'TIME_WINDOW|window:' || split_part(label, ':', 2)
               ELSE 'ZONE_' || kind || '|' || zone || ':' || split_part(label, ':', 2) END AS fk FROM hyp),
wide AS (
  SELECT fk, any_value(zone) AS zone, count(*) AS n_stations, avg(lift) AS lift, any_value(kind) = 'STATION_WINDOW' AS win,
         floor(avg(ne))::BIGINT AS mne, floor(avg(a))::BIGINT AS ma, avg(rate_exposed) AS mre, avg(rate_unexposed) AS mru, min(p) AS mp, min(q) AS mq,
         first(struct_pack(ne, a, rate_exposed, rate_unexposed, p, q, confidence) ORDER BY confidence DESC, label DESC) AS b
  FROM fam GROUP BY fk
  HAVING (any_value(kind) = 'STATION_WINDOW' AND count(*) >= 6 AND stddev_pop(lift) / avg(lift) <= 0.30)
      OR (any_value(kind) <> 'STATION_WINDOW' AND count(*) >= 3 AND stddev_pop(lift) / avg(lift) <= 0.45)),
cons AS (
  SELECT split_part(fk, '|', 1) AS kind, split_part(fk, '|', 2) AS label, zone, n_stations, lift, (CASE WHEN win THEN b.ne ELSE mne END)::BIGINT AS ne,
         (CASE WHEN win THEN b.a ELSE ma END)::BIGINT AS a, CASE WHEN win THEN b.rate_exposed ELSE mre END AS rate_exposed,
         CASE WHEN win THEN b.rate_unexposed ELSE mru END AS rate_unexposed, CASE WHEN win THEN b.p ELSE mp END AS p, CASE WHEN win THEN b.q ELSE mq END AS q,
         CASE WHEN win THEN b.confidence * 0.9 ELSE least(0.99, b.confidence * 1.12) END AS confidence FROM wide
  UNION ALL SELECT kind, label, zone, 1, lift, ne, a::BIGINT, rate_exposed, rate_unexposed, p, q, confidence FROM fam WHERE fk NOT IN (SELECT fk FROM wide))"""


def cause_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    unit = F.col("o_orderkey").alias("unit")
    labels = orders.select(unit, (F.col("o_orderstatus") == "F").cast("int").alias("bad"))
    lot = F.concat(F.lit("LOT-"), F.floor(F.col("o_orderkey") / 480).cast("string"))
    exposed = (
        orders.select(F.lit("LOT").alias("kind"), lot.alias("label"), unit)
        .union(orders.select(F.lit("OPERATOR"), "o_orderpriority", unit))
        .union(orders.filter("o_totalprice > 300000").select(F.lit("ENVIRONMENT"), F.lit("high_total"), unit))
        .union(
            lines.filter("l_quantity > 45")
            .select(F.lit("STATION_SIGNAL"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")), "l_orderkey")
            .distinct()
        )
    )
    return causes.contingency(exposed, labels)


def charts(spark: SparkSession, sf_dir: str, chart: str, size: int = 20) -> DataFrame:
    means = block_means(spark, sf_dir, size)
    base = spc.baseline(means)
    return spc.cusum(means, base) if chart == "cusum" else spc.ewma(means, base)


def station_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant.sql(spark, sf_dir, f"WITH {STATION_EXPOSED} SELECT * FROM exposed")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    labels = orders.select(F.col("o_orderkey").alias("unit"), (F.col("o_orderstatus") == "F").cast("int").alias("bad"))
    table = causes.fisher(causes.contingency(station_exposures(spark, sf_dir), labels))
    return causes.ranked(causes.benjamini_hochberg(table, ["kind", "label"])).withColumn("zone", F.expr(ZONE_OF))


def q_consolidate(spark, sf_dir):
    return rounded(causes.consolidate(hypotheses(spark, sf_dir)))


def q_containment(spark, sf_dir):
    exposed = station_exposures(spark, sf_dir)
    hyps = hypotheses(spark, sf_dir)
    visits = plant.scans(spark, sf_dir)
    spans = visits.groupBy("unit").agg(F.min("release_s").alias("started_s"), F.max("true_s").alias("gone_s"))
    member = causes.members(causes.consolidate(hyps), hyps)
    out = causes.containment(member, exposed, spans, F.lit(20000.0))
    return out.withColumn("units_in_line", F.array_join("units_in_line", ","))


def q_budget_plan(spark, sf_dir):
    stock = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("sid"), (100000 + F.floor(F.abs("s_acctbal") * 10)).alias("cost"), F.col("s_acctbal").alias("value")
    )
    return investment.plan_within_budget(stock, 700_000, [-F.col("value")])


def q_spc_score(spark, sf_dir):
    """Each event type as a station; its charts' first blocks as days of eight blocks; a fault a type at day 2."""
    fired = None
    for name in ("cusum", "ewma"):
        chart = charts(spark, sf_dir, name)
        onset = F.min_by("onset", "blk") if name == "cusum" else F.lit(None).cast("long")
        start = chart.filter("flag").groupBy("series").agg(onset.alias("onset"))
        got = spc.first_signal(chart).join(start, "series", "left").select(
            F.col("series").alias("station"), F.lit(name.upper()).alias("chart"), F.lit("value").alias("signal"),
            F.when(F.col("first_blk") >= 0, F.col("first_blk") / 8.0).alias("first_day"), (F.col("onset") / 8.0).alias("onset_day"),
        )
        fired = got if fired is None else fired.union(got)
    faults = block_means(spark, sf_dir).select(F.concat(F.lit("F-"), "series").alias("fault_id"), F.col("series").alias("target")).distinct()
    return rounded(spc.score_against_faults(fired, faults.withColumn("start_day", F.lit(2.0))))


def q_spc_scan(spark, sf_dir):
    out = None
    for name in ("cusum", "ewma"):
        got = spc.first_signal(charts(spark, sf_dir, name)).select("series", F.lit(name).alias("chart"), "first_blk", "n_signals")
        out = got if out is None else out.union(got)
    return out


def q_spc_sweep(spark, sf_dir):
    out = None
    means = block_means(spark, sf_dir)
    base = spc.baseline(means)
    for limit in (3.0, 3.5, 4.1, 4.6, 5.2):
        got = spc.first_signal(spc.ewma(means, base, limit=limit)).agg(
            F.count_if(F.col("first_blk") >= 0).alias("n_firing"), F.sum("n_signals").alias("n_flags")
        )
        got = got.select(F.lit(limit).alias("ewma_l"), "n_firing", "n_flags")
        out = got if out is None else out.union(got)
    return out


def repaired(spark, sf_dir):
    dup = feed.repair_duplicates(plant.scans(spark, sf_dir))
    return feed.repair_late(dup, feed.late_floors(dup))


def drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = plant.scans(spark, sf_dir)
    half = spark.read.parquet(f"{sf_dir}/orders.parquet").agg((F.max("o_orderkey") / 2).alias("half"))  # one row
    scans = scans.crossJoin(F.broadcast(half)).withColumn("offset_s", F.expr(DRIFT.format(half="half")))
    return scans.withColumn("x", F.col("x") + F.col("offset_s")).drop("half")


def drift_of_all(scans: DataFrame) -> DataFrame:
    return feed.clock_drift(scans, share=0.5)


def repair_report(spark, sf_dir):
    scans = drifting(spark, sf_dir)
    dup = feed.repair_duplicates(scans)
    repaired = feed.repair_late(dup, feed.late_floors(dup))
    return feed.repair_report(repaired, feed.station_quality(scans, drift_of_all(scans)))


def q_repair_scored(spark, sf_dir):
    true = F.col("true_s") + F.col("offset_s")
    injected = drifting(spark, sf_dir).agg(
        F.sum(F.col("x").isNull().cast("long")).alias("n_missed"),
        F.sum((F.col("x") < true - 1).cast("long")).alias("n_duplicate"),
        F.sum((F.col("x") > true + 1).cast("long")).alias("n_late"),
    )
    return feed.score_repair(repair_report(spark, sf_dir), injected)


def q_residual_fill(spark, sf_dir):
    """A unit in fifty has one read left, at the third station."""
    thin = repaired(spark, sf_dir).withColumn("x_late", F.when((F.col("unit") % 50 != 7) | (F.col("j") == 3), F.col("x_late")))
    return rounded(feed.fill_rest(feed.interpolate(thin)).select("unit", "j", "x_full"))


def q_spc_stoppage(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = events.filter("event_id < 2000").groupBy("event_type").agg((F.avg("value") + 4 * F.stddev_pop("value")).alias("top"))
    stops = events.join(first, "event_type").withColumn("stop", (F.col("value") > F.col("top")).cast("double"))
    return rounded(spc.blocks(stops, "event_type", ["ts", "event_id"], "stop", 20))


SIGNAL = "SELECT series, coalesce(min(CASE WHEN held THEN blk - 1 END), -1) AS first_blk, sum(flag::INT)::BIGINT AS n_signals FROM (SELECT *, sum(flag::INT) OVER (PARTITION BY series ORDER BY blk ROWS 1 PRECEDING) = 2 AS held FROM {chart}) GROUP BY series"

QUERIES = {
    "q_spc_blocks": lambda s, d: rounded(block_means(s, d)),
    "q_spc_baseline": lambda s, d: rounded(spc.baseline(block_means(s, d))),
    "q_spc_cusum": lambda s, d: rounded(charts(s, d, "cusum")),
    "q_spc_ewma": lambda s, d: rounded(charts(s, d, "ewma")),
    "q_spc_first_signal": lambda s, d: spc.first_signal(charts(s, d, "cusum")),
    "q_spc_scan": q_spc_scan,
    "q_spc_sweep": q_spc_sweep,
    "q_spc_stoppage": q_spc_stoppage,
    "q_dup_repair": lambda s, d: rounded(feed.repair_duplicates(plant.scans(s, d)).select("unit", "j", "x_dup")),
    "q_late_repair": lambda s, d: rounded(repaired(s, d).select("unit", "j", "x_late")),
    "q_interp_missing": lambda s, d: rounded(feed.interpolate(repaired(s, d)).select("unit", "j", "x_fill")),
    "q_residual_fill": q_residual_fill,
    "q_station_quality": lambda s, d: rounded(feed.station_quality(drifting(s, d), drift_of_all(drifting(s, d)))),
    "q_repair_report": lambda s, d: rounded(repair_report(s, d)),
    "q_repair_scored": q_repair_scored,
    "q_reconstruct_states": lambda s, d: rounded(feed.reconstruct(plant.scans(s, d), before="before_s")),
    "q_soft_sensor_mle": lambda s, d: rounded(kernels.censored_cycle_times(feed.reconstruct(plant.scans(s, d), before="before_s"))),
    "q_line_run": lambda s, d: rounded(
        kernels.run_line(plant.scans(s, d).select(F.floor(F.col("unit") / 500).alias("run"), "unit", "j", "release_s", "proc_s"))
    ),
    "q_spc_score": q_spc_score,
    "q_consolidate": q_consolidate,
    "q_containment": q_containment,
    "q_budget_plan": q_budget_plan,
    "q_contingency": lambda s, d: rounded(cause_table(s, d).select("kind", "label", "ne", "a", "rate_exposed", "rate_unexposed", "lift")),
    "q_fisher": lambda s, d: rounded(causes.fisher(cause_table(s, d)).select("kind", "label", "p")),
    "q_bh_fdr": lambda s, d: rounded(causes.benjamini_hochberg(causes.fisher(cause_table(s, d)), ["kind", "label"]).select("kind", "label", "p", "q")),
    "q_rc_ranked": lambda s, d: rounded(
        causes.ranked(causes.benjamini_hochberg(causes.fisher(cause_table(s, d)), ["kind", "label"])).select("kind", "label", "lift", "q", "confidence")
    ),
}
ORACLES = {
    "q_spc_blocks": f"WITH {BLOCKS} SELECT series, blk, round(m, 6) AS m FROM means",
    "q_spc_baseline": f"WITH {BLOCKS} SELECT series, round(mu, 6) AS mu, round(sd, 6) AS sd FROM base",
    "q_spc_cusum": f"WITH {CUSUM} SELECT series, blk, round(hi, 6) AS hi, round(lo, 6) AS lo, round(stat, 6) AS stat, onset, flag FROM cusum",
    "q_spc_ewma": f"WITH {EWMA} SELECT series, blk, round(stat, 6) AS stat, round(lim, 6) AS lim, flag FROM flagged",
    "q_spc_first_signal": f"WITH {CUSUM} {SIGNAL.format(chart='cusum')}",
    "q_spc_scan": f"WITH {CUSUM} SELECT series, 'cusum' AS chart, first_blk, n_signals FROM ({SIGNAL.format(chart='cusum')}) UNION ALL "
    f"(WITH {EWMA} SELECT series, 'ewma', first_blk, n_signals FROM ({SIGNAL.format(chart='flagged')}))",
    "q_spc_sweep": f"""WITH {EWMA}, swept AS (SELECT l, series || '@' || l AS series, blk, abs(stat) > lim * l / 5.5 AND blk >= 10 AS flag
      FROM ewma, (VALUES (3.0::DOUBLE), (3.5), (4.1), (4.6), (5.2)) AS v(l)),
      sig AS ({SIGNAL.format(chart='swept')})
      SELECT l AS ewma_l, count_if(first_blk >= 0)::BIGINT AS n_firing, sum(n_signals)::BIGINT AS n_flags FROM sig JOIN (SELECT DISTINCT l, series FROM swept) USING (series) GROUP BY l""",
    "q_spc_stoppage": """WITH top AS (SELECT event_type, avg(value) + 4 * stddev_pop(value) AS top FROM events WHERE event_id < 2000 GROUP BY 1),
      seq AS (SELECT event_type AS series, (value > top)::DOUBLE AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events JOIN top USING (event_type))
      SELECT series, (rn // 20)::BIGINT AS blk, round(avg(v), 6) AS m FROM seq GROUP BY ALL HAVING count(*) = 20""",
    "q_dup_repair": f"WITH {FEED} SELECT unit, j, round(x_dup, 6) AS x_dup FROM dup",
    "q_late_repair": f"WITH {FEED} SELECT unit, j, round(x_late, 6) AS x_late FROM late",
    "q_interp_missing": f"""WITH {FEED},
      near AS (SELECT a.unit, a.j, a.x_late, max(b.j) FILTER (WHERE b.j <= a.j) AS j0, min(b.j) FILTER (WHERE b.j >= a.j) AS j1, count(b.j) AS n
        FROM late a LEFT JOIN late b ON a.unit = b.unit AND b.x_late IS NOT NULL GROUP BY ALL)
      SELECT near.unit, near.j, round(CASE WHEN n >= 2 THEN coalesce(near.x_late,
        p.x_late + (f.x_late - p.x_late) * (near.j - j0) / nullif(j1 - j0, 0), p.x_late, f.x_late) END, 6) AS x_fill
      FROM near LEFT JOIN late p ON p.unit = near.unit AND p.j = j0 LEFT JOIN late f ON f.unit = near.unit AND f.j = j1""",
    "q_residual_fill": f"""WITH {FEED},
      thin AS (SELECT unit, j, release_s, CASE WHEN unit % 50 <> 7 OR j = 3 THEN x_late END AS x FROM late),
      near AS (SELECT a.unit, a.j, any_value(a.release_s) AS release_s, any_value(a.x) AS x, max(b.j) FILTER (WHERE b.j <= a.j) AS j0, min(b.j) FILTER (WHERE b.j >= a.j) AS j1, count(b.j) AS n
        FROM thin a LEFT JOIN thin b ON a.unit = b.unit AND b.x IS NOT NULL GROUP BY a.unit, a.j),
      fill AS (SELECT near.unit, near.j, near.release_s, CASE WHEN n >= 2 THEN coalesce(near.x, p.x + (f.x - p.x) * (near.j - j0) / nullif(j1 - j0, 0), p.x, f.x) END AS x
        FROM near LEFT JOIN thin p ON p.unit = near.unit AND p.j = j0 LEFT JOIN thin f ON f.unit = near.unit AND f.j = j1)
      SELECT unit, j, round(coalesce(x, median(x) OVER (PARTITION BY j), release_s), 6) AS x_full FROM fill""",
    "q_station_quality": f"WITH {DIRTY} SELECT j, round(missing_rate, 6) AS missing_rate, round(drift_s, 6) AS drift_s, drifted, round(quality, 6) AS quality FROM quality",
    "q_repair_report": f"""WITH {DIRTY} SELECT n_missing, n_duplicates, n_late, n_drifted, round(overall_quality, 6) AS overall_quality,
      concat_ws('; ', CASE WHEN n_missing > 0 THEN n_missing || ' missing reads filled in; confidence is lower there' END, CASE WHEN n_duplicates > 0 THEN n_duplicates || ' repeated or inverted reads moved' END,
        CASE WHEN n_late > 0 THEN n_late || ' late reads moved back' END, CASE WHEN n_drifted > 0 THEN n_drifted || ' readers with clock drift, not corrected' END) AS notes FROM report""",
    "q_repair_scored": f"""WITH {DIRTY}, injected AS (
        SELECT count(*) FILTER (WHERE x IS NULL) AS n_missed, count(*) FILTER (WHERE (unit * 5 + j * 11) % 97 = 0 AND x IS NOT NULL) AS n_duplicate,
          count(*) FILTER (WHERE (unit * 3 + j * 7) % 53 = 0 AND (unit * 5 + j * 11) % 97 <> 0 AND x IS NOT NULL) AS n_late FROM dirty)
      SELECT n_missed AS missed_injected, n_missing AS missed_detected, round(n_missing / greatest(n_missed, 1), 4) AS missed_detection_rate, n_duplicate AS duplicates_injected,
        n_duplicates AS duplicates_corrected, report.n_late AS late_corrected, injected.n_late AS late_injected, n_drifted AS drift_readers_flagged FROM report, injected""",
    "q_reconstruct_states": f"""WITH {STATES} SELECT unit, j, round(arrive_s, 6) AS arrive_s, round(start_s, 6) AS start_s, round(dwell_s, 6) AS dwell_s,
      round(starved_s, 6) AS starved_s, round(theta_s, 6) AS theta_s, coalesce(dwell_s - theta_s < 1.5, false) AS blocked FROM state""",
    "q_spc_score": f"""WITH {CUSUM}, fired AS (
      SELECT series, 'CUSUM' AS chart, first_blk, onset FROM ({SIGNAL.format(chart='cusum')})
        LEFT JOIN (SELECT series, arg_min(onset, blk) AS onset FROM cusum WHERE flag GROUP BY series) USING (series)
      UNION ALL (WITH {EWMA} SELECT series, 'EWMA', first_blk, NULL FROM ({SIGNAL.format(chart='flagged')}))),
      hit AS (SELECT *, first_blk / 8 AS day, onset / 8 AS onset_day FROM fired WHERE first_blk >= 0 AND first_blk / 8 >= 1.5),
      best AS (SELECT series, first(struct_pack(chart, day, onset_day) ORDER BY day, chart) AS b,
        first(onset_day ORDER BY day) FILTER (WHERE chart = 'CUSUM' AND onset_day IS NOT NULL) AS cus FROM hit GROUP BY series)
      SELECT 'F-' || t.series AS fault_id, t.series AS target, 2e0 AS start_day, b IS NOT NULL AS detected, b.chart AS chart,
        CASE WHEN b IS NOT NULL THEN 'value' END AS signal, round(b.day, 6) AS detect_day, round(b.day - 2, 2) AS lag_days,
        round(coalesce(cus, b.onset_day), 6) AS onset_day, round(coalesce(cus, b.onset_day) - 2, 2) AS onset_error_days
      FROM (SELECT DISTINCT series FROM means) t LEFT JOIN best USING (series)""",
    "q_consolidate": f"""WITH {HYPS} SELECT kind, label, zone, n_stations, ne, a, round(rate_exposed, 6) AS rate_exposed, round(rate_unexposed, 6) AS rate_unexposed,
      round(lift, 6) AS lift, round(p, 6) AS p, round(q, 6) AS q, round(confidence, 6) AS confidence FROM cons""",
    "q_containment": f"""WITH {HYPS}, {plant.PLANT}, span AS (SELECT unit, min(release_s) AS s, max(true_s) AS e FROM scan GROUP BY unit),
      mem AS (SELECT DISTINCT cons.label AS hypothesis, fam.kind, fam.label FROM cons JOIN fam ON fam.fk = cons.kind || '|' || cons.label OR (fam.kind = cons.kind AND fam.label = cons.label)),
      hit AS (SELECT DISTINCT hypothesis, unit FROM mem JOIN exposed USING (kind, label)),
      st AS (SELECT hypothesis, unit, CASE WHEN e <= 20000 THEN 's' WHEN s > 20000 THEN 'n' ELSE 'l' END AS state FROM hit JOIN span USING (unit))
      SELECT hypothesis, count(*) AS n_exposed, count(*) FILTER (WHERE state = 'l') AS n_in_line, count(*) FILTER (WHERE state = 's') AS n_shipped,
        count(*) FILTER (WHERE state = 'n') AS n_not_started,
        coalesce(array_to_string((list(unit ORDER BY unit) FILTER (WHERE state = 'l'))[1:250], ','), '') AS units_in_line FROM st GROUP BY hypothesis""",
    "q_budget_plan": """WITH RECURSIVE item AS (SELECT s_suppkey::VARCHAR AS sid, 100000 + floor(abs(s_acctbal) * 10)::BIGINT AS cost,
        row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier),
      step(r, n, spend, sid, cost, took) AS (
        SELECT 0::BIGINT, 0, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, false
        UNION ALL SELECT item.r, n + (n < 5 AND spend + item.cost <= 700000)::INT, spend + CASE WHEN n < 5 AND spend + item.cost <= 700000 THEN item.cost ELSE 0 END,
          item.sid, item.cost, n < 5 AND spend + item.cost <= 700000 FROM step JOIN item ON item.r = step.r + 1)
      SELECT n - 1 AS place, sid, cost FROM step WHERE took""",
    "q_contingency": f"WITH {CAUSES} SELECT kind, label, ne, a::BIGINT AS a, round(rate_exposed, 6) AS rate_exposed, round(rate_unexposed, 6) AS rate_unexposed, round(lift, 6) AS lift FROM tab",
    "q_fisher": f"WITH {CAUSES} SELECT kind, label, round(p, 6) AS p FROM fisher",
    "q_bh_fdr": f"WITH {CAUSES} SELECT kind, label, round(p, 6) AS p, round(q, 6) AS q FROM bh",
    "q_rc_ranked": f"WITH {CAUSES} SELECT kind, label, round(lift, 6) AS lift, round(q, 6) AS q, round(least(1, greatest(0, (1 - q) * tanh((lift - 1) / 2) * least(1, a / 25))), 6) AS confidence FROM bh",
}
