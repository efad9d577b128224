"""Root-cause statistics: contingency counts, the one-sided exact test, and false-discovery control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contingency(exposed: DataFrame, labels: DataFrame, least: int = 25, by: tuple[str, ...] = ()) -> DataFrame:
    """by, kind, label, ne, a, n, nd, rates and lift of each candidate, from (by, kind, label, unit) and (by, unit, bad).

    Both arms need `least` units, and the exposed one the higher rate. The masks are never built: one hash
    aggregate counts the exposed, and the totals, one row a key, join it.
    """
    total = labels.groupBy(*by).agg(F.count("*").alias("n"), F.sum("bad").alias("nd"))
    found = exposed.join(labels, [*by, "unit"]).groupBy(*by, "kind", "label").agg(F.count("*").alias("ne"), F.sum("bad").alias("a"))
    out = (found.join(total, list(by)) if by else found.crossJoin(F.broadcast(total))).filter((F.col("ne") >= least) & (F.col("n") - F.col("ne") >= least))
    out = out.withColumn("rate_exposed", F.col("a") / F.col("ne"))
    out = out.withColumn("rate_unexposed", (F.col("nd") - F.col("a")) / (F.col("n") - F.col("ne")))
    out = out.filter(F.col("rate_exposed") > F.col("rate_unexposed"))
    return out.withColumn("lift", F.col("rate_exposed") / F.greatest("rate_unexposed", F.lit(1e-9)))


STEPS = 4096  # terms of a tail that are summed at a time


def stirling_error(n: float) -> float:
    """ln n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m) / m) / m) / n


def deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation where the two are close."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v = (x - mean) / (x + mean)
    total, power, k = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = total + power / (2 * k + 1)
        if more == total:
            return total
        total, k = more, k + 1


def ln_binomial(x: int, n: int, p: float) -> float:
    """ln of the chance of x of n at p each, by its saddle point: exact at any size."""
    if x == 0 or x == n:
        return n * (math.log(p) if x else math.log1p(-p)) if n else 0.0
    off = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return off + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def upper_tail(n: int, nd: int, ne: int, a: int) -> float:
    """The chance of a or more bad among ne drawn from n with nd bad.

    The tail that doesn't hold the mean is summed from its first term by the ratios of one term to the next, which shrink; it ends
    where the rest, a geometric series at most, is below 1e-17 of the sum. Some ten deviations of terms matter, STEPS are held.
    """
    low, high = max(0, ne + nd - n), min(ne, nd)
    if a <= low or a > high:
        return float(a <= low)
    up = a * n > ne * nd
    k = a if up else a - 1
    if up:
        above, below, left = (nd - k, ne - k), (k + 1, n - nd - ne + k + 1), high - k
    else:
        above, below, left = (k, n - nd - ne + k), (nd - k + 1, ne - k + 1), k - low
    share = ne / n  # between 0 and 1, or low and high would be one
    first = ln_binomial(k, nd, share) + ln_binomial(ne - k, n - nd, share) - ln_binomial(ne, n, share)
    term = total = 1.0
    at = 0
    while at < left:
        i = np.arange(at, min(at + STEPS, left), dtype=float)
        ratios = (above[0] - i) * (above[1] - i) / ((below[0] + i) * (below[1] + i))
        terms = term * np.cumprod(ratios)
        total += float(terms.sum())
        term, at = float(terms[-1]), at + len(i)
        if ratios[-1] < 1 and term * ratios[-1] / (1 - ratios[-1]) < 1e-17 * total:
            break
    part = min(1.0, math.exp(first) * total)
    return part if up else 1 - part


@F.pandas_udf(T.DoubleType())
def upper_tails(n: pd.Series, nd: pd.Series, ne: pd.Series, a: pd.Series) -> pd.Series:
    return pd.Series([upper_tail(*map(int, row)) for row in zip(n, nd, ne, a, strict=True)], dtype=float)


def fisher(table: DataFrame) -> DataFrame:
    """Adds p, the chance of a or more bad units among ne exposed ones of n with nd bad: a hypergeometric tail."""
    return table.withColumn("p", upper_tails("n", "nd", "ne", "a"))


def slot_of_p(p: Column) -> Column:
    """A slot of p values, in their order: 4096 equal ones, and finer ones toward 0."""
    fine = F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * 64)
    return F.when(p >= 2.0**-12, F.floor(p * 4096)).otherwise(-fine).cast("long")


def benjamini_hochberg(table: DataFrame, tie: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds q: the least p m / rank over this rank and all larger ones, in each key; ties go by the columns of `tie`.

    However many candidates there are: p values, which lie between 0 and 1, fall into fixed slots. Ranks and least values are found
    in each slot, and carried over the slots, of which a key has some 60,000 at most. The tested candidates, one row each for all the
    units that they count, are persisted, as they are read four times.
    """
    keys = [*by, "__slot"]
    rows = table.withColumn("__slot", slot_of_p(F.col("p"))).persist()
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*by).orderBy("__slot")  # of slots
    before = sizes.select(
        *keys,
        (F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__m"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("p", *tie)) + F.col("__before")
    rows = rows.join(before, keys).withColumn("__rank", rank).withColumn("__v", F.col("p") * F.col("__m") / F.col("__rank"))
    least = rows.groupBy(*keys).agg(F.min("__v").alias("__v"))
    later = least.select(*keys, F.min("__v").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    own = F.min("__v").over(Window.partitionBy(*keys).orderBy("__rank").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = rows.join(later, keys).withColumn("q", F.least(F.lit(1.0), own, "__later"))
    return out.select(*table.columns, "q")


def ranked(table: DataFrame) -> DataFrame:
    """Adds confidence, from q, lift and the number of bad exposed units."""
    lift = (F.col("lift") - 1) / 2
    raw = (1 - F.col("q")) * F.tanh(lift) * F.least(F.lit(1.0), F.col("a") / 25)
    return table.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


FEWEST = {"ZONE": 3, "TIME_WINDOW": 6}
WIDEST = {"ZONE": 0.45, "TIME_WINDOW": 0.30}


def family(kind: Column, label: Column, zone: Column) -> Column:
    """The family of a hypothesis that may stand for one wider cause: (form, kind, zone, signal), or null.

    A label is `station:signal`. Signals of one zone form a zone family; sub-windows with one name, a time window.
    """
    part = F.split(label, ":", 2)[1]
    return F.when(
        kind.isin("STATION_SIGNAL", "ENVIRONMENT") & (zone != ""),
        F.struct(F.lit("ZONE").alias("form"), kind.alias("kind"), zone.alias("zone"), part.alias("signal")),
    ).when(
        kind == "STATION_WINDOW",
        F.struct(F.lit("TIME_WINDOW").alias("form"), kind.alias("kind"), F.lit("").alias("zone"), part.alias("signal")),
    )


def consolidate(hyps: DataFrame) -> DataFrame:
    """kind, label, zone, n_stations, ne, a, rates, lift, p, q, confidence: families whose lifts agree become one row.

    A zone takes three stations with a lift spread (population deviation over mean) of at most 0.45, a time window six
    and 0.30. The zone row has mean counts and rates, the least p and q and 1.12 times the best confidence (0.99 at most);
    the window row has those of its most confident member and 0.9 times its confidence. Other hypotheses stay.
    """
    rows = hyps.withColumn("family", family(F.col("kind"), F.col("label"), F.coalesce("zone", F.lit(""))))
    best = F.struct("confidence", "label")
    zone = F.col("family.form") == "ZONE"
    merged = rows.filter(F.col("family").isNotNull()).groupBy("family").agg(
        F.count("*").alias("n_stations"), F.avg("lift").alias("lift"), F.stddev_pop("lift").alias("spread"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("ne", "a", "rate_exposed", "rate_unexposed")),
        *(F.min(c).alias(f"least_{c}") for c in ("p", "q")),
        *(F.max_by(c, best).alias(f"best_{c}") for c in ("ne", "a", "rate_exposed", "rate_unexposed", "p", "q", "confidence")),
    )

    def limit(of: dict) -> Column:
        return F.when(zone, of["ZONE"]).otherwise(of["TIME_WINDOW"])

    agree = F.col("spread") / F.greatest("lift", F.lit(1e-9)) <= limit(WIDEST)
    merged = merged.filter((F.col("n_stations") >= limit(FEWEST)) & agree)
    either = {c: F.when(zone, F.floor(f"mean_{c}")).otherwise(F.col(f"best_{c}")).cast("long") for c in ("ne", "a")}
    either |= {c: F.when(zone, F.col(f"mean_{c}")).otherwise(F.col(f"best_{c}")) for c in ("rate_exposed", "rate_unexposed")}
    either |= {c: F.when(zone, F.col(f"least_{c}")).otherwise(F.col(f"best_{c}")) for c in ("p", "q")}
    confidence = F.when(zone, F.least(F.lit(0.99), F.col("best_confidence") * 1.12)).otherwise(F.col("best_confidence") * 0.9)
    wider = merged.select(
        F.when(zone, F.concat(F.lit("ZONE_"), "family.kind")).otherwise("TIME_WINDOW").alias("kind"),
        F.when(zone, F.concat_ws(":", "family.zone", "family.signal")).otherwise(F.concat(F.lit("window:"), "family.signal")).alias("label"),
        F.col("family.zone").alias("zone"), "n_stations", "lift", *(e.alias(c) for c, e in either.items()), confidence.alias("confidence"),
    )
    gone = merged.select("family")
    alone = rows.join(gone, "family", "left_anti").withColumn("n_stations", F.lit(1).cast("long"))
    return wider.unionByName(alone.select(*wider.columns))


def members(hyps: DataFrame, candidates: DataFrame) -> DataFrame:
    """(hypothesis, kind, label): the candidates (kind, label, zone) for which each hypothesis (kind, label, zone) stands.

    Both tables are dimensions of some hundreds of rows; the candidates with a member key meet on it.
    """
    fam = family(F.col("kind"), F.col("label"), F.coalesce("zone", F.lit("")))
    zone_key = F.concat(F.lit("ZONE_"), "f.kind", F.lit("|"), "f.zone", F.lit(":"), "f.signal")
    wide = F.when(F.col("f.form") == "ZONE", zone_key).otherwise(F.concat(F.lit("TIME_WINDOW|window:"), "f.signal"))
    own = F.concat_ws("|", "kind", "label")
    keyed = candidates.withColumn("f", fam).select("kind", "label", F.explode(F.array(own, wide)).alias("key")).filter("key IS NOT NULL")
    return hyps.select(F.col("label").alias("hypothesis"), own.alias("key")).join(keyed, "key").select("hypothesis", "kind", "label").distinct()


def containment(member: DataFrame, exposed: DataFrame, spans: DataFrame, now_s: Column, listed: int = 250, salts: int = 64) -> DataFrame:
    """Of each hypothesis: the exposed units in the line, shipped and not started at now_s, and the first `listed` in the line.

    member is (hypothesis, kind, label), exposed (kind, label, unit), spans (unit, started_s, gone_s). A unit that several
    members expose counts once. The list is a top-k report in two levels, so that no task orders a hypothesis' units.
    """
    units = exposed.join(member, ["kind", "label"]).select("hypothesis", "unit").distinct().join(spans, "unit")
    state = F.when(F.col("gone_s") <= now_s, "shipped").when(F.col("started_s") > now_s, "not_started").otherwise("in_line")
    units = units.select("hypothesis", "unit", state.alias("state"))
    counts = units.groupBy("hypothesis").agg(
        F.count("*").alias("n_exposed"),
        *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("in_line", "shipped", "not_started")),
    )
    salted = units.filter("state = 'in_line'").withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(salts)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("hypothesis", "salt").orderBy("unit"))).filter(F.col("r") <= listed)
    top = first.groupBy("hypothesis").agg(F.slice(F.array_sort(F.collect_list("unit")), 1, listed).alias("units_in_line"))
    return counts.join(top, "hypothesis", "left").withColumn("units_in_line", F.coalesce("units_in_line", F.array().cast("array<bigint>")))
