"""What the operators of this package share: table access, the shared work folder, row-wise Arrow
maps, and dealing the rows of a key over blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A table of at most this many rows is small enough to be broadcast (a few MB).
BROADCAST_ROWS = 20_000
# Rows of which a row-wise map holds the new values at a time.
SLICE_ROWS = 500
# Letters that are worked on at a time in arrays; a longer text alone.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


@lru_cache
def own_dir(application: str) -> str:
    """A folder for an application whose session names none, as in local tests."""
    return tempfile.mkdtemp(prefix=f"spark-{application}-")


def fresh_folder(spark: SparkSession) -> str:
    """A new, empty folder below the shared one, which is deleted when the application ends."""
    path = f"{shared_dir(spark)}/taktwerk/{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_folder() made."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read again: cuts the lineage, survives a lost executor.

    The table is deleted when the application ends, or by forget() before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taktwerk/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/taktwerk/" in path:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are few; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def apart(keep: list[str], new: set[str]) -> dict[str, str]:
    """The names that kept columns get beside new ones: their own, or with `_kept` behind it where a new one has it."""
    names: dict[str, str] = {}
    for k in dict.fromkeys(keep):
        name = k
        while name in new or name in names.values() or (name != k and name in keep):
            name += "_kept"
        names[k] = name
    return names


def map_column(
    df: DataFrame,
    column: str | list[str],
    keep: list[str],
    fields: list[T.StructField],
    setup: Callable[[], Callable[..., dict[str, list]]],
    binary: bool = False,
) -> DataFrame:
    """Carry `keep` through and add `fields`, which setup()(values of `column`) returns as lists by name.

    column: one, or several, whose values come as so many lists. setup runs once in each task. Batches are streamed, and worked
    on in slices of SLICE_ROWS rows, so a task holds one Arrow batch (which Spark bounds by bytes) and the new values of one
    slice. With binary=True the first column, a text, arrives as its UTF-8 bytes. A kept column named like a new field gets
    `_kept` behind its name; `column` itself travels once, kept or not.
    """
    columns = [column] if isinstance(column, str) else column
    names = apart(keep, {f.name for f in fields})
    schema = T.StructType([*(T.StructField(n, df.schema[k].dataType, df.schema[k].nullable) for k, n in names.items()), *fields])
    arrow = to_arrow_schema(schema)
    moved = [*columns, *(k for k in names if k not in columns)]
    at = [moved.index(k) for k in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                values = [part.column(i) for i in range(len(columns))]
                if binary:
                    values[0] = values[0].cast(pa.binary())
                got = work(*(v.to_pylist() for v in values))
                arrays = [part.column(i) for i in at]
                arrays += [pa.array(got[f.name], arrow.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*moved).mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k values in a row, put together from those of powers of two."""
    power, width, part = BASE, 1, values
    out, done = None, 0
    while True:
        if k & width:
            if out is None:
                out, done = part, width
            else:
                n = len(values) - done - width + 1
                out, done = out[:n] * power + part[done : done + n], done + width
        if done == k:
            return mixed(out)
        part = part[:-width] * power + part[width:]
        power, width = np.uint64(int(power) ** 2 & (1 << 64) - 1), width * 2


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts some at a time, with the first one's number: CHUNK letters at most, a longer text alone."""
    at = 0
    while at < len(texts):
        to, letters = at + 1, len(texts[at])
        while to < len(texts) and letters + len(texts[to]) < CHUNK:
            letters += len(texts[to]) + 1
            to += 1
        yield at, texts[at:to]
        at = to


def deal(rows: DataFrame, key: str, row: str, heavy: DataFrame) -> DataFrame:
    """Deal the rows of each key so that any two of them meet in one (key, block_i, block_j), however many they are.

    heavy has (key, n_blocks) of the keys with more rows than one task should hold; rows of other keys get one block pair, (0, 0).
    """
    return in_blocks(rows.join(small(heavy), key, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))), row)


def in_blocks(rows: DataFrame, row: str) -> DataFrame:
    """Rows that hold their key's n_blocks, dealt: they fall into blocks by a hash of `row`, and a row goes to every pair of blocks
    that holds its own (column `block`)."""
    out = rows.withColumn("block", F.pmod(F.xxhash64(row, F.lit(7)), F.col("n_blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)))
    out = out.withColumn("block_i", F.least("block", "other")).withColumn("block_j", F.greatest("block", "other"))
    return out.drop("n_blocks", "other")


def heavy_keys(keys: DataFrame, key: str, block_rows: int) -> DataFrame:
    """(key, n_blocks) of the keys that have more than block_rows rows; counted with partial sums, then written."""
    counts = keys.groupBy(key).count().filter(F.col("count") > block_rows)
    return written(counts.select(key, F.ceil(F.col("count") / block_rows).cast("int").alias("n_blocks")))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by keys, cut so that no key is split, each with the first row of every key and its end."""
    held: list[pa.RecordBatch] = []

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        differs = np.zeros(batch.num_rows, bool)
        differs[:1] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            differs[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(differs), batch.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1] == batch.column(k)[-1] for k in keys):
            held.append(batch)
            continue
        whole = pa.concat_batches([*held, batch]) if held else batch
        at = starts(whole)
        held = [whole.slice(at[-2])]
        if len(at) > 2:
            yield whole.slice(0, at[-2]), at[:-1]
    if held:
        whole = pa.concat_batches(held)
        yield whole, starts(whole)


def star(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: for each row, the smallest row that it reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        best = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new
