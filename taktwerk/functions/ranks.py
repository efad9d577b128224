"""Positions, ranks, lags and running values over a whole order, without one task that sorts it all.

The order column's range is cut into slots at approximate quantiles, about `rows_per_slot` rows each, so an outlier or a skewed
clock fills no slot with all rows. A window then sorts one slot; what a slot needs of those before
it is a row or a few for each slot, put together over the table of slots. Where all rows fit one slot, no cut is made. The order
column must be numeric or a timestamp, and rows that share one of its values share a slot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROWS_PER_SLOT = 2_000_000
MOST_SLOTS = 4096  # beyond, slots grow
BINS = 4 * MOST_SLOTS  # quantiles that part the slots further, to find a slot's last rows without sorting it
BINS_PER_SLOT = 64  # at most
ACCURACY = 10_000  # of approximate quantiles: ranks are off by one in so many at most


def number(df: DataFrame, column: str) -> Column:
    x = F.col(column)
    return (x.cast("timestamp") if df.schema[column].dataType.typeName().startswith("timestamp") else x).cast("double")


@dataclass(frozen=True)
class Slots:
    """Where an order is cut: slot k holds the values from bounds[k - 1] up to, without it, bounds[k]; nulls have slot -1.

    fine: more values at which slots may be parted into bins.
    """

    order: str
    bounds: tuple[float, ...]
    fine: tuple[float, ...] = ()

    def on(self, df: DataFrame) -> DataFrame:
        """Adds __slot."""
        return self.numbered(df, self.bounds, "__slot")

    def binned(self, df: DataFrame) -> DataFrame:
        """Adds __slot and __bin; a bin lies in one slot, and bins have the order of their rows."""
        return self.numbered(self.on(df), tuple(sorted({*self.bounds, *self.fine})), "__bin")

    def numbered(self, df: DataFrame, bounds: tuple[float, ...], name: str) -> DataFrame:
        cut = df.withColumn("__x", F.nullif(number(df, self.order), F.lit(float("nan"))))
        if not bounds:
            place = F.lit(0.0)
        else:
            cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__x", outputCol="__b", handleInvalid="keep").transform(cut)
            place = F.col("__b")
        return cut.withColumn(name, F.when(F.col("__x").isNull(), -1).otherwise(place).cast("long")).drop("__x", "__b")


def slots_of(df: DataFrame, order: str, rows_per_slot: int = ROWS_PER_SLOT) -> Slots | None:
    """The slots of an order, from a count and, if one slot doesn't do, one aggregate more; None if it does.

    The count needs no column, so windows and joins that only add columns drop out of it.
    """
    if df.count() <= rows_per_slot:
        return None
    probes = F.split(F.lit(",".join(str(k / BINS) for k in range(1, BINS))), ",").cast("array<double>")  # one literal, as so many cost seconds
    x = number(df, order)
    n, at = df.agg(F.count(order), F.percentile_approx(x, probes, 10 * MOST_SLOTS)).first()
    slots = min(math.ceil(n / rows_per_slot), MOST_SLOTS)
    if slots <= 1:
        return None
    edges = lambda places: tuple(sorted({at[k] for k in places if math.isfinite(at[k])}))
    evenly = lambda parts: edges(math.ceil(k * BINS / parts) - 1 for k in range(1, parts))
    return Slots(order, evenly(slots), evenly(min(slots * BINS_PER_SLOT, BINS)))


def same_key_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join on keys that may be null, each with itself; the table's own copies of the keys go."""
    named = table.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(c for c in table.columns if c not in keys))
    on = [rows[k].eqNullSafe(named[f"__k_{k}"]) for k in keys]
    return rows.join(named, on, how).drop(*(f"__k_{k}" for k in keys))


def running(table: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """(by, order, name): the sum of value over the rows before, for a table of slots."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return table.select(*by, order, F.coalesce(F.sum(value).over(w), F.lit(0).cast(table.schema[value].dataType)).alias(name))


def positions(
    df: DataFrame, by: list[str], order: list[str], name: str = "pos", rows_per_slot: int = ROWS_PER_SLOT, slots: list[Slots | None] | None = None, few_keys: bool = False
) -> DataFrame:
    """Adds the place of each row, from 0, among the rows of its key; nulls of the order come first.

    slots: what slots_of gave for the same order in a list of one, if the caller has it; else it is computed here.
    few_keys: the keys are a dimension, so the counts of slots are broadcast and the rows move once.
    """
    cuts = slots[0] if slots else slots_of(df, order[0], rows_per_slot)
    if cuts is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - F.lit(1).cast("long"))
    cut = cuts.on(df)
    own = F.row_number().over(Window.partitionBy(*by, "__slot").orderBy(*order)) - F.lit(1).cast("long")
    before = running(cut.groupBy(*by, "__slot").agg(F.count("*").alias("__n")), by, "__slot", "__n", "__before")
    before = F.broadcast(before) if few_keys else before
    return same_key_join(cut, before, [*by, "__slot"]).withColumn(name, own + F.col("__before")).drop("__slot", "__before")


def haloed(
    df: DataFrame, by: list[str], order: list[str], most: int, rows_per_slot: int = ROWS_PER_SLOT, slots: list[Slots | None] | None = None, few_keys: bool = True
) -> tuple[DataFrame, WindowSpec]:
    """The rows in slots, each slot led by the `most` rows of the key before it, and the window in which to look back over them.

    Column __own is false for rows that only lead another slot; they are dropped once the window is through. The rows that lead are told
    from counts by bin, so the rows move once, and neither a join nor a second sort of them is needed: a bin goes along with each slot that
    begins fewer than `most` rows of the key behind the bin's end. few_keys: the keys are a dimension, so these bins are broadcast.
    """
    cuts = slots[0] if slots else slots_of(df, order[0], rows_per_slot)
    if cuts is None:
        return df.withColumn("__own", F.lit(True)), Window.partitionBy(*by).orderBy(*order)
    cut = cuts.binned(df)
    bins = cut.groupBy(*by, "__bin").agg(F.first("__slot").alias("__slot"), F.count("*").alias("__n"))  # a bin lies in one slot
    along = Window.partitionBy(*by).orderBy("__bin")
    bins = bins.withColumn("__end", F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bins = bins.withColumn("__next", F.nullif(F.lead("__slot").over(along), F.col("__slot")))  # the slot that begins behind this bin
    near = Window.partitionBy(*by).orderBy("__end").rangeBetween(Window.currentRow, max(most, 1) - 1)
    leads = bins.select(*by, "__bin", F.collect_list("__next").over(near).alias("__to")).filter(F.size("__to") > 0)
    out = same_key_join(cut, F.broadcast(leads) if few_keys else leads, [*by, "__bin"], "left")
    own = F.array(F.struct(F.col("__slot").alias("__at"), F.lit(True).alias("__own")))
    others = F.transform("__to", lambda s: F.struct(s.alias("__at"), F.lit(False).alias("__own")))
    out = out.select(*df.columns, F.inline(F.when(F.col("__to").isNull(), own).otherwise(F.concat(own, others))))
    return out, Window.partitionBy(*by, "__at").orderBy(*order)


def rows_before(column: str | Column, k: int | str, distances: list[int], w: WindowSpec) -> Column:
    """The column's value k rows earlier in a window; k is a number, or a column that is one of `distances` and null elsewhere."""
    if isinstance(k, int):
        return F.lag(column, k).over(w)
    return F.coalesce(*(F.when(F.col(k) == d, F.lag(column, d).over(w)) for d in distances), F.lit(None))


def lagged(
    df: DataFrame, by: list[str], order: list[str], what: dict[str, str], k: int | str = 1, rows_per_slot: int = ROWS_PER_SLOT,
    slots: list[Slots | None] | None = None, distances: list[int] | None = None, few_keys: bool = True,
) -> DataFrame:
    """Adds, for each new name, the column's value k rows earlier in the order of the key; null for the first k rows.

    k: a number of at least one, or a column that is one of `distances` in each row; null where it isn't. A slot gets the last rows of
    those before it, as many as the farthest distance, so no table is joined with itself.
    """
    far = sorted({k} if isinstance(k, int) else set(distances or []))
    if not far:
        return df.select("*", *(F.lit(None).cast(df.schema[c].dataType).alias(name) for name, c in what.items()))
    rows, w = haloed(df, by, order, far[-1], rows_per_slot, slots, few_keys)
    out = rows.select("*", *(rows_before(c, k, far, w).alias(name) for name, c in what.items()))
    return out.filter("__own").drop("__own", "__at")


def cumulated(table: DataFrame, order: str, values: list[str], rows_per_slot: int = ROWS_PER_SLOT, by: list[str] | None = None) -> DataFrame:
    """Adds `<value>_before`, the sum over all rows of the key with a smaller order value; order values must be distinct in a key."""
    by = by or []
    cut = (slots_of(table, order, rows_per_slot) or Slots(order, ())).on(table)
    within = Window.partitionBy(*by, "__slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "__slot").agg(*(F.sum(v).alias(v) for v in values))
    past = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__slot", *(F.coalesce(F.sum(v).over(past), F.lit(0)).alias(f"__s_{v}") for v in values))
    cut = same_key_join(cut, sums, [*by, "__slot"])
    for v in values:
        cut = cut.withColumn(f"{v}_before", F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"__s_{v}"))
    return cut.drop("__slot", *(f"__s_{v}" for v in values))


def running_max(
    df: DataFrame, by: list[str], order: list[str], what: dict[str, str], rows_per_slot: int = ROWS_PER_SLOT, slots: list[Slots | None] | None = None
) -> DataFrame:
    """Adds, for each new name, the largest value of a column over all earlier rows of the key; null for the first.

    In two levels: within a slot by a window, and over the slots before by a window over their maxima.
    """
    cuts = slots[0] if slots else slots_of(df, order[0], rows_per_slot)
    cut = df.withColumn("__slot", F.lit(0).cast("long")) if cuts is None else cuts.on(df)
    within = Window.partitionBy(*by, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if cuts is not None:
        past = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        tops = cut.groupBy(*by, "__slot").agg(*(F.max(c).alias(f"__m{i}") for i, c in enumerate(what.values())))
        tops = tops.select(*by, "__slot", *(F.max(f"__m{i}").over(past).alias(f"__m{i}") for i in range(len(what))))
        cut = same_key_join(cut, tops, [*by, "__slot"])
    for i, (name, c) in enumerate(what.items()):
        top = F.max(c).over(within)
        cut = cut.withColumn(name, top if cuts is None else F.greatest(top, f"__m{i}"))
    return cut.drop("__slot", *(f"__m{i}" for i in range(len(what))))


def running_sum(
    df: DataFrame, by: list[str], order: list[str], value: str, name: str, rows_per_slot: int = ROWS_PER_SLOT, slots: list[Slots | None] | None = None
) -> DataFrame:
    """Adds the sum of a column over this row and all earlier ones of the key, in two levels as running_max."""
    cuts = slots[0] if slots else slots_of(df, order[0], rows_per_slot)
    cut = df.withColumn("__slot", F.lit(0).cast("long")) if cuts is None else cuts.on(df)
    within = Window.partitionBy(*by, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if cuts is None:
        return cut.withColumn(name, F.sum(value).over(within)).drop("__slot")
    before = running(cut.groupBy(*by, "__slot").agg(F.sum(value).alias("__n")), by, "__slot", "__n", "__before")
    return same_key_join(cut, before, [*by, "__slot"]).withColumn(name, F.sum(value).over(within) + F.col("__before")).drop("__slot", "__before")


def average_ranks(df: DataFrame, column: str, name: str, rows_per_slot: int = ROWS_PER_SLOT, by: list[str] | None = None) -> DataFrame:
    """Adds the rank from 1 by a column without nulls; ties share the mean of their ranks. Ties are counted before they are ranked.

    Rows whose value differs between two evaluations of df get lost, so it must be given by tables or computed once.
    """
    by = by or []
    ties = df.groupBy(*by, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = cumulated(ties, "__v", ["__n"], rows_per_slot, by)
    ranked = ranked.select(*by, F.col("__v").alias("__tie"), (F.col("__n_before") + (F.col("__n") + 1) / 2).alias(name))
    return same_key_join(df.withColumn("__tie", F.col(column)), ranked, [*by, "__tie"]).drop("__tie")


def quantiles(df: DataFrame, by: list[str], column: str, shares: list[float], few_keys: bool = True) -> DataFrame:
    """(by, k, n, value): the quantile at shares[k] of each key, linear between neighbours; nulls don't count, keys of nulls alone have none.

    few_keys: the keys are a dimension, such as stations, so a row for each is broadcast. No key may be named k, n or value.

    Exact, in two passes and without a job before the query: approximate quantiles bracket each wanted place, and only what lies
    in a bracket, some 6 rows in ACCURACY and their ties, is counted by value and ordered.
    """
    known = df.select(*by, F.col(column).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    margin = 3 / ACCURACY
    probes = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-margin, margin)]
    at = known.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__x", probes, ACCURACY).alias("__q"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))

    def end(i: int) -> Column:  # few rows are all in the bracket, as a margin of theirs is less than a row
        least, most = F.col("__lo"), F.col("__hi")
        near = least if probes[i] == 0 else most if probes[i] == 1 else F.col("__q")[i]
        return F.when(F.col("n") < 4 * ACCURACY, most if i % 2 else least).otherwise(near)

    brackets = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("s"), end(2 * k).alias("a"), end(2 * k + 1).alias("b")) for k, s in enumerate(shares)))
    at = at.select(*by, "n", brackets.alias("__w"))
    rows = same_key_join(known, F.broadcast(at) if few_keys else at, by) if by else known.crossJoin(F.broadcast(at))  # one row
    rows = rows.select(*by, "__x", "n", F.explode("__w").alias("w")).filter(F.col("__x") <= F.col("w.b"))
    below = F.col("__x") < F.col("w.a")
    ties = rows.groupBy(*by, "n", F.col("w.k").alias("k"), F.col("w.s").alias("__s"), F.when(~below, F.col("__x")).alias("__x")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by, "k").orderBy("__x")  # what lies below the bracket is one row without a value, the first
    ties = ties.withColumn("__end", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.col("__s") * (F.col("n") - 1)
    part = lambda p: (F.col("__end") - F.col("__c") <= p) & (p < F.col("__end"))
    low, high = (F.max(F.when(part(p) & F.col("__x").isNotNull(), F.col("__x"))) for p in (F.floor(place), F.ceil(place)))
    found = ties.groupBy(*by, "k", "n", "__s").agg(low.alias("__a"), high.alias("__b"))
    return found.select(*by, "k", "n", (F.col("__a") + (F.col("__b") - F.col("__a")) * (place - F.floor(place))).alias("value"))
