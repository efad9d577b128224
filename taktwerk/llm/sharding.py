"""Sharding by extendible hashing: only oversized buckets split, on one more bit of the hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import apart, forget, small, written

MAX_BITS = 32


def hash_bits(id_col: str, salt_col: str | None):
    """The first 32 bits of an md5 of the id (and of a second column, so that rows of one id can part), as a long."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if salt_col:
        key = F.concat(key, F.lit("\n"), F.coalesce(F.col(salt_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def prefix(hash_col: str, bits: int):
    return F.shiftright(F.col(hash_col), MAX_BITS - bits)


def directory(sizes: DataFrame, max_bytes: int, step: int = 4) -> DataFrame:
    """(depth, prefix, n_docs, n_bytes, fits) of every shard, from (hash, n_docs, n_bytes) of the documents' hashes.

    Buckets start as one, of depth 0. Those beyond max_bytes split on the next bit, round after round, `step`
    bits in each; the others stay. A bucket of one hash, or of 32 bits, can't be split and stays with fits = false.
    Each round sums the hashes of the open buckets alone, with partial sums, so a hot bucket is no single task.
    """
    done = None
    open_rows, depth = sizes, 0
    while True:
        depths = list(range(depth, min(depth + step, MAX_BITS + 1)))
        spread = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix("hash", d).alias("prefix")) for d in depths)))
        sums = (
            open_rows.withColumn("at", spread)
            .groupBy("at.depth", "at.prefix")
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        )
        sums = written(sums.withColumn("fits", F.col("n_bytes") <= max_bytes).withColumn("leaf", F.expr("fits OR lo = hi")))
        inner = sums.filter("NOT leaf").select("depth", "prefix")
        for d in depths:  # a shard's parent, if it is among these depths, must be open
            level = sums.filter((F.col("depth") == d) & (F.col("leaf") | (F.col("depth") == MAX_BITS)))
            if d > depths[0]:
                up = inner.filter(F.col("depth") == d - 1).select(F.col("prefix").alias("up"))
                level = level.join(up, F.shiftright("prefix", 1) == F.col("up"), "left_semi")
            shards = level.select("depth", "prefix", "n_docs", "n_bytes", "fits")
            done = shards if done is None else done.union(shards)
        left = inner.filter(F.col("depth") == depths[-1]).select(F.col("prefix").alias("open"))
        if depths[-1] == MAX_BITS or not left.take(1):
            return written(done)
        open_rows = open_rows.join(small(written(left)), prefix("hash", depths[-1]) == F.col("open"), "left_semi")
        depth = depths[-1] + 1


def shard(
    docs: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bytes: int = 16 << 20,
    salt_col: str | None = None,
) -> DataFrame:
    """Carries `keep` and adds shard (its hash prefix in bits, `all` for the only shard), shard_depth, n_bytes (of the
    row's text in UTF-8) and fits (whether the shard keeps to max_bytes; false where one id alone exceeds it).

    The same rows give the same shards at any partitioning. A null text counts no bytes; a null id hashes as
    an empty one; rows that repeat an id share its shard unless salt_col parts them; an empty table stays empty. A kept column
    named like a new one gets `_kept` behind its name.
    The directory is broadcast if its rows are few and joined by a shuffle of the hashes otherwise.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    new = {"n_bytes", "shard", "shard_depth", "fits"}
    names = apart(keep, new)
    rows = docs.select(F.struct(*(F.col(k).alias(v) for k, v in names.items()), size.alias("n_bytes")).alias("row"), hash_bits(id_col, salt_col).alias("hash"))
    hashes = docs.select(hash_bits(id_col, salt_col).alias("hash"), size.alias("n_bytes"))
    sizes = written(hashes.groupBy("hash").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes")))
    table = directory(sizes, max_bytes)
    forget(sizes)
    depths = sorted(r.depth for r in table.select("depth").distinct().collect()) or [0]  # at most 33
    # a row's prefixes at the depths in use, one of which is a shard
    at = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix("hash", d).alias("prefix")) for d in depths)))
    name = F.when(F.col("depth") == 0, F.lit("all")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    found = rows.select("row", at.alias("at")).select("row", "at.depth", "at.prefix")
    return found.join(small(table.select("depth", "prefix", "fits")), ["depth", "prefix"]).select(
        "row.*", name.alias("shard"), F.col("depth").alias("shard_depth"), "fits"
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 16 << 20) -> None:
    """Writes docs to path, a folder for each shard, named b and its bits, which no reader takes for a number.

    Rows go to writers by shard, so each shard is one file.
    """
    out = shard(docs, docs.columns, id_col, text_col, max_bytes)
    kept = apart(docs.columns, {"n_bytes", "shard", "shard_depth", "fits"})
    named = F.concat(F.lit("b"), F.col("shard")).alias("shard")
    out.repartition("shard").select(*kept.values(), named).write.partitionBy("shard").parquet(path)
