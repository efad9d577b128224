"""Defect risk: gradient-boosted trees, class-conditional conformal levels over recent blocks, and decisions."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from taktwerk.functions import metrics
from taktwerk.functions.ranks import ROWS_PER_SLOT, positions, same_key_join


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep").transform(rows.fillna(0.0, features))


def fit_risk(
    train: DataFrame, features: list[str], label: str = "y", rounds: int = 20, depth: int = 5, step: float = 0.2, held_percent: int = 0, bins: int = 32
) -> GBTClassificationModel:
    """Boosted trees of the label on the features (nulls count as 0), distributed over the rows; the seed makes the fit repeatable.

    held_percent: so many of a hundred rows, by a hash of their features, are held out of the fit; it stops before `rounds` once they don't
    gain any more.
    """
    trees = GBTClassifier(labelCol=label, featuresCol="__features", maxIter=rounds, maxDepth=depth, stepSize=step, seed=17, maxBins=bins)
    rows = assembled(train, features)
    if held_percent:
        rows = rows.withColumn("__held", F.pmod(F.xxhash64(*features), F.lit(100)) < held_percent)
        trees = trees.setValidationIndicatorCol("__held").setValidationTol(0.001)
    rows = rows.select(label, "__features", *(["__held"] if held_percent else [])).persist()
    try:
        return trees.fit(rows)
    finally:
        rows.unpersist()


def with_risk(rows: DataFrame, model: GBTClassificationModel | None, features: list[str]) -> DataFrame:
    """Adds score, the probability of a defect; 0 without a model."""
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    scored = model.transform(assembled(rows, features)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "score")


def conformal_levels(calib: DataFrame, alpha: float = 0.1, least: int = 20, by: tuple[str, ...] = (), rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(by, y, n, q) from rows (by, y, score): the quantile of 1 - p of the true class at ceil((n + 1) (1 - alpha)) / n, the higher
    neighbour; 1 with fewer than `least` rows of a class. Places come from slots of the order, so no class must fit a task."""
    keys = [*by, "y"]
    rows = calib.select(*keys, F.when(F.col("y") == 1, 1 - F.col("score")).otherwise(F.col("score")).alias("s"))
    placed = positions(rows, keys, ["s"], "place", rows_per_slot).join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))
    wanted = F.least(F.ceil(level * (F.col("n") - 1)), F.col("n") - 1)
    q = F.when(F.col("n") < least, 1.0).otherwise(F.col("s"))
    return placed.filter(F.col("place") == wanted).select(*keys, "n", q.alias("q"))


def recalibrated(levels: DataFrame, block: str, least: int = 20) -> DataFrame:
    """(block, y, q): levels of blocks with fewer than `least` rows of a class keep what the last block with enough had, 1 without one."""
    w = Window.partitionBy("y").orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("n") >= least, F.col("q"))
    return levels.select(block, "y", F.coalesce(F.last(known, ignorenulls=True).over(w), F.lit(1.0)).alias("q"))


def decide(rows: DataFrame, levels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds in0, in1, decision and confidence to rows (by, score), from levels (by, y, q); a class without a level has 1.

    A class is in the set if 1 less its chance is at most its level. Both or none in it: `abstain`, and none `flag`; else the class, `flag` or
    `pass`. Confidence is how far the decided class lies inside its level, from 0 to 1; an abstention has 0.
    """
    keys = list(by)
    q = levels.groupBy(*keys).agg(*(F.max(F.when(F.col("y") == k, F.col("q"))).alias(f"__q{k}") for k in (0, 1)))  # a row a key
    out = same_key_join(rows, q, keys, "left") if keys else rows.crossJoin(F.broadcast(q))
    q0, q1 = (F.coalesce(f"__q{k}", F.lit(1.0)) for k in (0, 1))
    risk = F.col("score")
    out = out.withColumn("in1", 1 - risk <= q1).withColumn("in0", risk <= q0)
    both = F.col("in1") & F.col("in0")
    out = out.withColumn("decision", F.when(both, "abstain").when(F.col("in0"), "pass").otherwise("flag"))
    inside = F.when(F.col("decision") == "flag", 1 - (1 - risk) / F.greatest(q1, F.lit(1e-6))).when(F.col("decision") == "pass", 1 - risk / F.greatest(q0, F.lit(1e-6))).otherwise(0.0)
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside))).drop("__q0", "__q1")


def evaluate(decided: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row a key: n, prevalence, coverage of both classes, shares of flags and abstentions, precision, recall, share of defects passed."""
    y, flag = F.col("y").cast("double"), F.col("decision") == "flag"
    share = lambda hit, of=F.lit(True): F.avg(F.when(of, hit.cast("double")))
    return decided.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("prevalence"),
        share(F.col("in1"), F.col("y") == 1).alias("coverage_defect"),
        share(F.col("in0"), F.col("y") == 0).alias("coverage_ok"),
        share(flag).alias("flag_rate"),
        share(F.col("decision") == "abstain").alias("abstain_rate"),
        F.avg(F.when(flag, y)).alias("flag_precision"),
        (F.coalesce(F.sum(F.when(flag, y)), F.lit(0.0)) / F.greatest(F.sum(y), F.lit(1.0))).alias("flag_recall"),
        F.avg(F.when(F.col("decision") == "pass", y)).alias("pass_miss_rate"),
    )


def rolling(rows: DataFrame, test_start: int, block: int = 480, calib_window: int = 1920, alpha: float = 0.1, least: int = 20) -> DataFrame:
    """Adds block_start, in0, in1, decision and confidence to rows (unit, score, y) of units from test_start on.

    Each block of units is decided with the levels of the calib_window units before it, so that a drift of the line moves the levels
    too; a class with fewer than `least` rows there keeps the level of the last block with enough. A row goes to the blocks
    that look back on it by arithmetic, calib_window / block of them at most, and no block waits for another.
    """
    own = F.floor((F.col("unit") - test_start) / block)
    first = F.greatest(own + 1, F.lit(0))
    last = F.floor((F.col("unit") - test_start + calib_window) / block)
    blocks = rows.filter(F.col("unit") >= test_start).select((own * block + test_start).alias("block_start")).distinct()
    seen = rows.filter(first <= last).withColumn("block_start", F.explode(F.transform(F.sequence(first, last), lambda b: b * block + test_start)))
    seen = seen.join(blocks, "block_start").select("block_start", "y", "score")
    levels = conformal_levels(seen, alpha, least, ("block_start",))
    every = blocks.crossJoin(rows.sparkSession.range(2).select(F.col("id").cast("int").alias("y")))  # two classes
    levels = every.join(levels.withColumn("y", F.col("y").cast("int")), ["block_start", "y"], "left").na.fill(0, ["n"])
    levels = recalibrated(levels, "block_start", least)
    test = rows.filter(F.col("unit") >= test_start).withColumn("block_start", (own * block + test_start).cast("long"))
    return decide(test, levels, ("block_start",))


def prequential(decided: DataFrame, by: str = "block_start") -> DataFrame:
    """evaluate() of each block, with the block's own ROC AUC and average precision."""
    out = evaluate(decided, (by,))
    auc = metrics.roc_auc(decided, by=[by]).drop("n")
    return out.join(auc, by, "left").join(metrics.average_precision(decided, by=[by]), by, "left")


def prequential_summary(decided: DataFrame, by: str = "block_start") -> DataFrame:
    """One row: ROC AUC and average precision over all blocks, and the blocks' mean coverage, precision, recall and abstention."""
    blocks = evaluate(decided, (by,))
    means = blocks.agg(F.count("*").alias("n_blocks"), *(F.avg(c).alias(f"{c}_mean") for c in ("coverage_defect", "coverage_ok", "flag_precision", "flag_recall", "abstain_rate")))
    return means.crossJoin(metrics.roc_auc(decided).drop("n")).crossJoin(metrics.average_precision(decided))  # one row each


def time_split(rows: DataFrame, day: str, train_share: float = 0.65, calib_share: float = 0.15) -> DataFrame:
    """Adds part: `train`, `calib` or `test`, by day, so that no later day is learned from. Shares are of the days from the first to the last."""
    ends = rows.agg(F.min(day).alias("__d0"), F.max(day).alias("__d1"))  # one row
    length = F.col("__d1") - F.col("__d0") + 1
    at = F.col(day) - F.col("__d0")
    part = F.when(at < F.floor(length * train_share), "train").when(at < F.floor(length * (train_share + calib_share)), "calib").otherwise("test")
    return rows.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("__d0", "__d1")


def type_status(rows: DataFrame, least_train: int = 60, least_calib: int = 20) -> DataFrame:
    """(type, n_train, n_calib, status) from rows (type, part, y): which defect types have positives enough to be modelled."""
    counts = rows.groupBy("type").agg(
        F.sum(F.when(F.col("part") == "train", F.col("y")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("part") == "calib", F.col("y")).otherwise(0)).alias("n_calib"),
    )
    status = F.when(F.col("n_train") < least_train, "unmodelled: train").when(F.col("n_calib") < least_calib, "unmodelled: calib").otherwise("fitted")
    return counts.withColumn("status", status)


def typed_labels(units: DataFrame, findings: DataFrame, types: DataFrame) -> DataFrame:
    """(unit, type, y) for every unit and type, from findings (unit, type), and the other columns of units; types is a dimension (type), given by the line.

    A unit meets the types found on it in one array, before it is spread over all types.
    """
    found = findings.groupBy("unit").agg(F.collect_set("type").alias("__found"))
    asked = types.select("type").distinct()
    rows = units.join(found, "unit", "left").crossJoin(F.broadcast(asked))
    y = F.coalesce(F.array_contains("__found", F.col("type")), F.lit(False)).cast("int")
    return rows.select("unit", "type", *(c for c in units.columns if c != "unit"), y.alias("y"))


def evaluate_per_type(rows: DataFrame, features: list[str], alpha: float = 0.1, fit: dict | None = None, **limits: int) -> DataFrame:
    """(type, status, n, prevalence and so on): type_status of each type, and for the fitted ones evaluate() of its part `test`.

    rows is (type, unit, part, y, features). A model is fitted for each type with positives enough, and calibrated on its part `calib`.
    """
    status = statuses(rows, **limits)
    out = None
    for kind, model in fitted(rows, status, features, fit).items():
        if model is None:
            continue
        scored = with_risk(rows.filter(F.col("type") == kind), model, features)
        levels = conformal_levels(scored.filter("part = 'calib'"), alpha)
        one = evaluate(decide(scored.filter("part = 'test'"), levels)).withColumn("type", F.lit(kind).cast(rows.schema["type"].dataType))
        out = one if out is None else out.unionByName(one)
    table = rows.sparkSession.createDataFrame(status, type_status(rows).schema)  # a row for each defect type
    return table if out is None else table.join(F.broadcast(out), "type", "left")


def fit_per_type(rows: DataFrame, features: list[str], fit: dict | None = None, **limits: int) -> dict[str, GBTClassificationModel | None]:
    """A model for each defect type with positives enough, fitted on its rows of part `train`; None for the others.

    fit: what fit_risk takes beside rows and features.
    """
    return fitted(rows, statuses(rows, **limits), features, fit)


def statuses(rows: DataFrame, **limits: int) -> list[Row]:
    """type_status, a row for each defect type."""
    return type_status(rows, **limits).collect()


def fitted(rows: DataFrame, status: list[Row], features: list[str], fit: dict | None = None) -> dict[str, GBTClassificationModel | None]:
    models: dict[str, GBTClassificationModel | None] = {}
    for r in status:
        own = rows.filter((F.col("type") == r.type) & (F.col("part") == "train"))
        models[r.type] = fit_risk(own, features, **(fit or {})) if r.status == "fitted" else None
    return models
