"""Robustness sweeps: the whole way from scans to a score, once for each value of a parameter, as one job."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.ranks import ROWS_PER_SLOT, Slots, slots_of
from taktwerk.operators import feed

KEY = ("param",)
CASE = ("case",)
TRANSPORT_S, EPS_S, LEAST, LATE_SHARE = 4.5, 1.5, 200, 0.005
Step = Callable[[DataFrame], DataFrame]
AtStation = Callable[[int], Column]


def sweep(clean: DataFrame, values: list[float], inject: Step, build_states: Step, score: Step) -> DataFrame:
    """One row or more a value: clean scans times the values (column `param`), through the caller's three functions.

    Each takes and returns a DataFrame that keeps `param` as a key: inject adds the faulty scan x, build_states repairs and reconstructs,
    score aggregates by param. Nothing runs on the driver, and no value waits for another. Every window moves the feed once a value;
    the sweeps below move less.
    """
    params = F.explode(F.array(*(F.lit(float(v)) for v in values)))
    return score(build_states(inject(clean.withColumn("param", params))))


def raw_states(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The states from x as it is: what a fault that isn't repaired, such as a wrong clock, does to them."""
    return feed.reconstruct(rows, "x", keys=KEY, keep=keep)


def cases(clean: DataFrame, values: list[float], inject: AtStation, stations: list[int]) -> DataFrame:
    """(unit, release_s, case, t<j>..., x<j>...): a row a unit and case, with its true scans and the faulty ones of all stations.

    Case 0 is the clean feed, case i the i-th value; inject gives a station's faulty scan from `unit`, `param` and `true_s`. clean is (unit, j,
    release_s, true_s); a unit has passed a station if it has a true_s there. Only a row a unit moves.
    """
    wide = clean.groupBy("unit").agg(F.max("release_s").alias("release_s"), *(F.max(F.when(F.col("j") == j, F.col("true_s"))).alias(f"t{j}") for j in stations))
    each = F.array(*(F.struct(F.lit(i).alias("case"), F.lit(float(v) if i else None).cast("double").alias("param")) for i, v in enumerate([0.0, *values])))
    rows = wide.select("*", F.inline(each))
    for j in stations:
        x = F.when(F.col("case") == 0, F.col("true_s")).otherwise(inject(j))
        rows = rows.withColumn("true_s", F.col(f"t{j}")).withColumn(f"x{j}", x)
    return rows.select("unit", "release_s", "case", *(f"t{j}" for j in stations), *(f"x{j}" for j in stations))


def visits(rows: DataFrame, stations: list[int]) -> DataFrame:
    """(case, unit, j, release_s, x, before_s, before_j): the visits of cases(), each with the unit's scan at the station before and its number.

    The visits of a unit and station follow one another in all cases, so a shuffle by station compresses what they share.
    """
    before_s, before_j = F.lit(None).cast("double"), F.lit(None).cast("int")
    out = []
    for j in stations:
        here = F.col(f"t{j}").isNotNull()
        out.append(F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("x"), before_s.alias("before_s"), before_j.alias("before_j"), here.alias("here")))
        before_s, before_j = F.when(here, F.col(f"x{j}")).otherwise(before_s), F.when(here, F.lit(j)).otherwise(before_j)
    return rows.select("case", "unit", "release_s", F.inline(F.array(*out))).filter("here").drop("here")


def deduplicated(x: np.ndarray, here: np.ndarray, stations: list[int]) -> np.ndarray:
    """feed.repair_duplicates on rows of a unit's scans by station; nan is a missing read, and `here` where the unit passed."""
    out, top = np.full_like(x, np.nan), np.full(len(x), np.nan)
    for k, j in enumerate(stations):
        off = x[:, k] - j * TRANSPORT_S
        top = np.where(here[:, k], np.where(np.isnan(off), np.nan, np.fmax(top, off)), top)
        out[:, k] = np.where(here[:, k], j * TRANSPORT_S + top, np.nan)
    return out


def gaps(x: np.ndarray, here: np.ndarray) -> np.ndarray:
    """By how much each scan follows that of the unit's station before."""
    out, before = np.full_like(x, np.nan), np.full(len(x), np.nan)
    for k in range(x.shape[1]):
        out[:, k] = np.where(here[:, k], x[:, k] - before, np.nan)
        before = np.where(here[:, k], x[:, k], before)
    return out


def moved_back(x: np.ndarray, here: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """feed.repair_late on such rows; floors has a row of stations for each of them, nan where there is none."""
    out = np.full_like(x, np.nan)
    after, floor = np.full(len(x), np.nan), np.full(len(x), np.nan)
    for k in reversed(range(x.shape[1])):
        out[:, k] = np.where(here[:, k], np.where(after - x[:, k] < floor, after - floor, x[:, k]), np.nan)
        after, floor = np.where(here[:, k], x[:, k], after), np.where(here[:, k], floors[:, k], floor)
    return out


def filled(x: np.ndarray, here: np.ndarray, stations: list[int]) -> np.ndarray:
    """feed.interpolate on such rows."""
    read, none = ~np.isnan(x), np.full(len(x), np.nan)

    def nearest(order: Iterable[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        at, value, found = none, none, {}
        for k in order:
            at, value = np.where(read[:, k], float(stations[k]), at), np.where(read[:, k], x[:, k], value)
            found[k] = (at, value)
        return found

    back, ahead = nearest(range(len(stations))), nearest(reversed(range(len(stations))))
    out = np.full_like(x, np.nan)
    for k, j in enumerate(stations):
        (j0, x0), (j1, x1) = back[k], ahead[k]
        lerp = x0 + (x1 - x0) * (j - j0) / np.where(j1 == j0, np.nan, j1 - j0)
        best = x[:, k]
        for other in (lerp, x0, x1):
            best = np.where(np.isnan(best), other, best)
        out[:, k] = np.where(here[:, k] & (read.sum(axis=1) >= 2), best, np.nan)
    return out


def on_scans(rows: DataFrame, stations: list[int], change: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of cases() with x<j> changed in all but case 0, which is as it was, by a function of scans, passed stations and cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: np.stack([batch.column(f"{c}{j}").to_numpy(zero_copy_only=False).astype(float) for j in stations], axis=1)  # noqa: E731, B023
            x, here, case = of("x"), ~np.isnan(of("t")), batch.column("case").to_numpy()
            with np.errstate(invalid="ignore", divide="ignore"):
                y = np.where((case > 0)[:, None], change(x, here, case), x)
            new = {f"x{j}": pa.array(y[:, k], from_pandas=True) for k, j in enumerate(stations)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def counted_hops(rows: DataFrame, stations: list[int], part: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """(case, j, v, n): how often each number that `part` takes from the gaps of a case (its number) and station (its place) occurs, counted by batch and summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: np.stack([batch.column(f"{c}{j}").to_numpy(zero_copy_only=False).astype(float) for j in stations], axis=1)  # noqa: E731, B023
            x, here, case = of("x"), ~np.isnan(of("t")), batch.column("case").to_numpy()
            with np.errstate(invalid="ignore"):
                hop = gaps(deduplicated(x, here, stations), here)
            for c in np.unique(case):
                for k, j in enumerate(stations):
                    own = hop[case == c, k]
                    v, n = np.unique(part(own[~np.isnan(own)], int(c), k), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"case": np.full(len(v), c, "int32"), "j": np.full(len(v), j, "int32"), "v": v, "n": n.astype("int64")})

    kind = "long" if part(np.zeros(0), 0, 0).dtype.kind == "i" else "double"
    return rows.mapInArrow(run, f"case int, j int, v {kind}, n long").groupBy("case", "j", "v").agg(F.sum("n").alias("n"))


def coarse(x: np.ndarray) -> np.ndarray:
    """The leading bits of doubles, in the order of the doubles: a number for values within a 4,096th of each other."""
    bits = (x + 0.0).view("int64")  # -0.0 is 0.0
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits) >> 40


def floors_of(rows: DataFrame, stations: list[int], n_cases: int) -> np.ndarray:
    """feed.late_floors of each case: a row a case and a column a station, nan where there is none; in jobs of their own, for these few numbers.

    Exact: the first counts gaps by their leading bits, which tells in which of these the two places of the quantile lie; the second counts the gaps there.
    """
    rows, key = rows.filter(F.col("case") > 0), ["case", "j"]

    def places(counts: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*key).orderBy("v")
        return counts.withColumn("end", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))

    place = F.lit(LATE_SHARE) * (F.col("all") - 1)
    begin = F.col("end") - F.col("n")
    near = (begin <= F.ceil(place)) & (F.col("end") > F.floor(place)) & (F.col("all") >= LEAST)
    wanted: dict[tuple[int, int], list] = {}
    for r in places(counted_hops(rows, stations, lambda x, case, k: coarse(x))).filter(near).orderBy(*key, "v").collect():  # two rows a case and station at most
        wanted.setdefault((r.case, stations.index(r.j)), []).append(r)
    inside = {at: np.array([r.v for r in found]) for at, found in wanted.items()}
    exact = counted_hops(rows, stations, lambda x, case, k: x[np.isin(coarse(x), inside.get((case, k), []))])
    after = Window.partitionBy(*key).orderBy("v")
    starts = {at: found[0].end - found[0].n for at, found in wanted.items()}  # gaps below those that are counted
    base = F.coalesce(*(F.when((F.col("case") == c) & (F.col("j") == stations[k]), F.lit(n)) for (c, k), n in starts.items()), F.lit(0))
    total = F.coalesce(*(F.when((F.col("case") == c) & (F.col("j") == stations[k]), F.lit(found[0]["all"])) for (c, k), found in wanted.items()), F.lit(0))
    ends = exact.withColumn("all", total).withColumn("end", F.sum("n").over(after) + base)
    low, high = (F.max(F.when((begin <= p) & (F.col("end") > p), F.col("v"))) for p in (F.floor(place), F.ceil(place)))
    out = np.full((n_cases, len(stations)), np.nan)
    for r in ends.groupBy(*key, "all").agg(low.alias("a"), high.alias("b")).collect():  # a row a case and station
        p = LATE_SHARE * (r["all"] - 1)
        out[r.case, stations.index(r.j)] = r.a + (r.b - r.a) * (p - math.floor(p))
    return out


def errors(rows: DataFrame, values: list[float], eps_s: float = EPS_S) -> DataFrame:
    """By value, the mean errors of departure, start and dwell against case 0, and the share of equal flags of being blocked.

    rows are feed.served's, with case and before_j. All cases of a visit, and the gate that its unit finds at the next station, meet in one row:
    what lies in one slot is put together before it moves, and nothing moves a second time.
    """
    n = range(len(values) + 1)
    none = F.lit(None).cast("double")
    own = F.struct("j", F.col("x"), F.col("start_s"), none.alias("gate_s"), F.lit(True).alias("own"))
    gate = F.struct(F.col("before_j").alias("j"), none.alias("x"), none.alias("start_s"), F.col("earlier_s").alias("gate_s"), F.lit(False).alias("own"))
    both = rows.select("unit", "case", F.inline(F.array(own, gate))).filter("j IS NOT NULL")
    # a unit has a gate at a station if it passed it, so no row is of gates alone
    met = both.groupBy("unit", "j").agg(*(F.max(F.when(F.col("case") == i, F.col(c))).alias(f"{c}{i}") for i in n for c in ("x", "start_s", "gate_s")))
    x, start, late = (lambda i, c=c: F.col(f"{c}{i}") for c in ("x", "start_s", "gate_s"))
    dwell = lambda i: x(i) - start(i)
    blocked = lambda i: F.coalesce(dwell(i) - (late(i) - start(i)) < eps_s, F.lit(False))
    depart = lambda i: start(i) + dwell(i)
    sums = {
        "n": lambda i: F.count(depart(i)),
        "depart_mae_s": lambda i: F.avg(F.abs(depart(i) - x(0))),
        "start_mae_s": lambda i: F.avg(F.abs(start(i) - start(0))),
        "dwell_mae_s": lambda i: F.avg(F.abs(dwell(i) - dwell(0))),
        "blocked_agreement": lambda i: F.avg((blocked(i) == blocked(0)).cast("double")),
    }
    row = met.agg(F.count("*").alias("__rows"), *(of(i).alias(f"{name}__{i}") for i in n if i for name, of in sums.items())).filter("__rows > 0")
    return row.select(F.inline(F.array(*(F.struct(F.lit(float(v)).alias("param"), *(F.col(f"{name}__{i}").alias(name) for name in sums)) for i, v in enumerate(values, 1)))))


def arrays(columns: Callable[[str], np.ndarray], stations: list[int], bounds: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """(x, passed, arrival, slot) by row of cases() and station; the slot of a missing scan is -1, and -2 stands where the unit didn't pass."""
    x, here = (np.stack([columns(f"{c}{j}").astype(float) for j in stations], axis=1) for c in "xt")
    here = ~np.isnan(here)
    arrive, before = np.empty_like(x), np.full(len(x), np.nan)
    for k in range(len(stations)):
        came = before + TRANSPORT_S
        arrive[:, k] = np.where(np.isnan(came), columns("release_s"), came)
        before = np.where(here[:, k], x[:, k], before)
    slot = np.where(np.isnan(x), -1, np.searchsorted(np.array(bounds), x, side="right"))
    return x, here, arrive, np.where(here, slot, -2)


def last_two(found: np.ndarray) -> np.ndarray:
    """Of rows (cell, x, unit, arrival) the last two of each cell, in order; a missing x comes first."""
    found = found[:, np.lexsort((found[2], np.where(np.isnan(found[1]), -np.inf, found[1]), found[0]))]
    cell = np.r_[found[0], np.nan, np.nan]
    return found[:, (cell[:-2] != cell[1:-1]) | (cell[:-2] != cell[2:])]


def tails(rows: DataFrame, stations: list[int], n_cases: int, slots: Slots) -> np.ndarray:
    """[case, station, slot + 1]: scan and start of the last visit before the slot, nan where there is none; in a job of its own, two rows a cell."""
    k, width = len(stations), len(slots.bounds) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kept = [], 0
        for batch in batches:
            x, _, arrive, slot = arrays(lambda c: batch.column(c).to_numpy(zero_copy_only=False), stations, slots.bounds)  # noqa: B023
            cell = (batch.column("case").to_numpy()[:, None] * k + np.arange(k)) * width + slot + 1
            unit = np.repeat(batch.column("unit").to_numpy()[:, None], k, axis=1)
            found.append(np.stack([a[slot > -2].astype(float) for a in (cell, x, unit, arrive)]))
            if sum(f.shape[1] for f in found) > 2 * kept + 1_000_000:
                found = [last_two(np.concatenate(found, axis=1))]
                kept = found[0].shape[1]
        if found:
            cell, x, unit, arrive = last_two(np.concatenate(found, axis=1))
            yield pa.RecordBatch.from_pydict({"cell": cell.astype("int64"), "x": pa.array(x, from_pandas=True), "unit": unit.astype("int64"), "arrive": arrive})

    last = F.slice(F.sort_array(F.collect_list(F.struct("x", "unit", "arrive")), False), 1, 2)
    cells = rows.mapInArrow(run, "cell long, x double, unit long, arrive double").groupBy("cell").agg(last.alias("two"))
    out = np.full((n_cases * k, width, 2), np.nan)
    told = {r.cell: r.two for r in cells.collect()}
    for series in range(n_cases * k):
        two: list = []
        for s in range(width):
            if two:
                reach = [v for v in (two[0].arrive, two[1].x if len(two) > 1 else None) if v is not None]
                out[series, s] = two[0].x if two[0].x is not None else np.nan, max(reach, default=np.nan)
            two = [*told.get(series * width + s, []), *two][:2]
    return out.reshape(n_cases, k, width, 2)


SUMS = ("n", "depart", "n_start", "start", "n_dwell", "dwell", "n_depart", "rows", "agreed")
SERVED = "part long, unit long, j int, case int, x double, start_s double, earlier_s double, before_j int, " + ", ".join(f"{s} double" for s in SUMS)


def served_in_slots(rows: DataFrame, stations: list[int], n_cases: int, slots: Slots, eps_s: float = EPS_S) -> DataFrame:
    """What errors() needs, of rows in slots: SUMS of the units that lie in one slot with all their visits and cases (with part, the slot, and the case as j), and the visits of others.

    A unit moves as it is, a row a case, to each slot in which it has a scan; few have two. What a slot needs of those before it is one visit a case and station.
    """
    ends = tails(rows, stations, n_cases, slots)
    names = [f"x{j}" for j in stations] + [f"t{j}" for j in stations]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = arrays(lambda c: batch.column(c).to_numpy(zero_copy_only=False), stations, slots.bounds)[3]  # noqa: B023
            order = np.sort(slot, axis=1)
            new = (order > -2) & np.c_[np.ones(len(order), bool), order[:, 1:] != order[:, :-1]]
            row, at = np.nonzero(new)
            moved = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(order[row, at]), pa.array(new.sum(axis=1)[row] == 1), *moved.columns], names=["at", "alone", *batch.schema.names])

    def serve(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["unit", "case"])
        unit, case = df["unit"].to_numpy(), df["case"].to_numpy()
        x, here, arrive, slot = arrays(lambda c: df[c].to_numpy(), stations, slots.bounds)
        mine, place = slot == key[0], np.where(np.isnan(x), -np.inf, x)
        start, earlier = np.full((2, *x.shape), np.nan)
        for c in range(n_cases):
            for k in range(len(stations)):
                at = np.flatnonzero((case == c) & mine[:, k])
                at = at[np.lexsort((unit[at], place[at, k]))]
                left, began = ends[c, k, key[0] + 1]
                start[at, k] = np.fmax(arrive[at, k], np.r_[left, x[at, k]][:-1])
                earlier[at, k] = np.r_[began, start[at, k]][:-1]
        _, first, size = np.unique(unit, return_index=True, return_counts=True)
        whole = np.repeat((size == n_cases) & np.logical_and.reduceat(df["alone"].to_numpy(bool), first), size)
        by_case = lambda a: a[whole].reshape(-1, n_cases, len(stations))
        gate, after, before_j = np.full_like(x, np.nan), np.full(len(x), np.nan), np.full(x.shape, -1)
        for k in reversed(range(len(stations))):
            gate[:, k], after = after, np.where(here[:, k], earlier[:, k], after)
        last = np.full(len(x), -1)
        for k, j in enumerate(stations):
            before_j[:, k], last = last, np.where(here[:, k], j, last)
        dwell = x - start
        values = {"depart": start + dwell, "start": start, "dwell": dwell, "blocked": dwell - (gate - start) < eps_s}
        own, scan, passed = {n: by_case(v) for n, v in values.items()}, by_case(x)[:, 0], by_case(here)[:, 0]
        sums = []
        for i in range(1, n_cases):
            off = {n: np.abs(own[n][:, i] - (scan if n == "depart" else own[n][:, 0]))[passed] for n in ("depart", "start", "dwell")}
            same = (own["blocked"][:, i] == own["blocked"][:, 0])[passed]
            row = {n: np.nansum(v) for n, v in off.items()} | {f"n_{n}": np.count_nonzero(~np.isnan(v)) for n, v in off.items()}
            sums.append({"part": key[0], "j": i, "case": i, "n": np.count_nonzero(~np.isnan(own["depart"][:, i][passed])), "rows": len(same), "agreed": same.sum()} | row)
        row, k = np.nonzero(mine & ~whole[:, None])
        split = {"unit": unit[row], "j": np.array(stations)[k], "case": case[row], "x": x[row, k], "start_s": start[row, k], "earlier_s": earlier[row, k], "before_j": before_j[row, k]}
        out = pd.concat([pd.DataFrame(sums, columns=[c.split()[0] for c in SERVED.split(", ")]), pd.DataFrame(split)])
        return out.astype({c: "Int64" for c in ("part", "unit", "j", "case", "before_j")})

    moved = rows.select("unit", "case", "release_s", *names)
    moved = moved.mapInArrow(place, f"at long, alone boolean, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in moved.schema)}")
    return moved.groupBy("at").applyInPandas(serve, SERVED)


def errors_in_slots(served: DataFrame, values: list[float], eps_s: float = EPS_S) -> DataFrame:
    """errors() from served_in_slots: sums as they are, and the visits of units in several slots once their cases and gates have met."""
    n, none = range(len(values) + 1), F.lit(None).cast("double")
    own = F.struct("j", "x", "start_s", none.alias("gate_s"))
    gate = F.struct(F.nullif("before_j", F.lit(-1)).alias("j"), none.alias("x"), none.alias("start_s"), F.col("earlier_s").alias("gate_s"))
    both = served.select("part", "unit", "case", *SUMS, F.inline(F.array(own, gate))).filter("j IS NOT NULL")
    met = both.groupBy("part", "unit", "j").agg(
        *(F.max(F.when(F.col("part").isNull() & (F.col("case") == i), F.col(c))).alias(f"{c}{i}") for i in n for c in ("x", "start_s", "gate_s")), *(F.max(s).alias(s) for s in SUMS)
    )
    x, start, late = (lambda i, c=c: F.col(f"{c}{i}") for c in ("x", "start_s", "gate_s"))
    dwell = lambda i: x(i) - start(i)
    blocked = lambda i: F.coalesce(dwell(i) - (late(i) - start(i)) < eps_s, F.lit(False))
    depart = lambda i: start(i) + dwell(i)
    of = {"depart": lambda i: F.abs(depart(i) - x(0)), "start": lambda i: F.abs(start(i) - start(0)), "dwell": lambda i: F.abs(dwell(i) - dwell(0))}
    split = F.col("part").isNull()

    def total(i: int, name: str) -> Column:
        if name in of:
            mine = of[name](i)
        else:
            mine = {"rows": F.lit(1.0), "agreed": (blocked(i) == blocked(0)).cast("double"), "n": depart(i).isNotNull().cast("double")}.get(name)
            mine = of[name[2:]](i).isNotNull().cast("double") if mine is None else mine
        return F.sum(F.when(split, mine).when(F.col("j") == i, F.col(name)))

    row = met.agg(*(total(i, name).alias(f"{name}__{i}") for i in n if i for name in SUMS))
    mean = lambda i, name, count: (F.col(f"{name}__{i}") / F.nullif(F.col(f"{count}__{i}"), F.lit(0.0)))
    each = (
        F.struct(
            F.lit(float(v)).alias("param"), F.col(f"n__{i}").cast("long").alias("n"), *(mean(i, name, f"n_{name}").alias(f"{name}_mae_s") for name in ("depart", "start", "dwell")),
            mean(i, "agreed", "rows").alias("blocked_agreement"),
        ) for i, v in enumerate(values, 1)
    )
    return row.select(F.inline(F.array(*each)))


def scored(clean: DataFrame, rows: DataFrame, values: list[float], stations: list[int], rows_per_slot: int) -> DataFrame:
    """errors() of the cases in rows; their slots are those of the clean feed, which is read once for all of them. What fits one slot is parted by station instead."""
    slots = slots_of(clean, "true_s", max(rows_per_slot // (len(values) + 1), 1))
    if slots is None:
        served = feed.served(visits(rows, stations), "x", TRANSPORT_S, keep=("before_j",), keys=CASE, before="before_s", slots=[None])
        return errors(served, values)
    return errors_in_slots(served_in_slots(rows, stations, len(values) + 1, slots), values)


def sweep_read_rate(clean: DataFrame, percents: list[float], missed: AtStation, stations: list[int], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """The errors by the percentage of missed reads, once repaired and filled; missed gives a station's condition, which holds for `param` per cent of the rows."""
    rows = cases(clean, percents, lambda j: F.when(~missed(j), F.col("true_s")), stations)
    floors = floors_of(rows, stations, len(percents) + 1)

    def repaired(x: np.ndarray, here: np.ndarray, case: np.ndarray) -> np.ndarray:
        return filled(moved_back(deduplicated(x, here, stations), here, floors[case]), here, stations)

    return scored(clean, on_scans(rows, stations, repaired), percents, stations, rows_per_slot)


def sweep_clock_sync(clean: DataFrame, drifts_s: list[float], offset: AtStation, stations: list[int], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """The errors by how far station clocks are off; offset gives a station's own, in units of `param` seconds."""
    return scored(clean, cases(clean, drifts_s, lambda j: F.col("true_s") + F.col("param") * offset(j), stations), drifts_s, stations, rows_per_slot)
