"""Substring dedup by windows of words: a passage is found wherever its lines and sentences break."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import BASE, chunks, forget, mixed, rolled, runs, small, written
from taktwerk.llm.units import without_spans

# Code points of scripts that put no blanks between words; each counts as a word.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


@lru_cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are white space, and which are words of their own."""
    space, single = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    space[[i for i in range(0x110000) if chr(i).isspace()]] = True
    for lo, hi in UNSPACED:
        single[lo : hi + 1] = True
    return space, single


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start, end and hash of each word, A-Z folded; offsets in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space, single = (c[points] for c in classes())
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1] | single[:-1] | single[1:]
    last = solid.copy()
    last[:-1] &= space[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    folded = points + np.where((points >= 65) & (points <= 90), 32, 0)
    place = np.where(solid, np.arange(len(points)) - starts[np.maximum(np.cumsum(first) - 1, 0)], 0)
    powers = np.cumprod(np.full(int(place.max()) + 1, BASE))
    terms = np.where(solid, mixed(folded.astype(np.uint64) + BASE) * powers[place], np.uint64(0))
    return starts, ends, mixed(np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64))


def leftmost(values: np.ndarray, k: int) -> np.ndarray:
    """The place of the least of every k values in a row, the leftmost of equal ones."""
    width, part = 1, np.arange(len(values))

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    while width * 2 <= k:
        part, width = better(part[:-width], part[width:]), width * 2
    return part if width == k else better(part[: len(values) - k + 1], part[k - width :])


class Stretches:
    """Of some texts: stretches of windows (`size` words in a row) in a row that have one anchor.

    The anchor of a window is the least hash of a third of its words in a row, the leftmost of equal ones: equal windows have
    equal anchors, and neighbours mostly share theirs. text, anchor, first and count are of each stretch: the text's number,
    the anchor's hash, the first window's number in its text, and the windows.
    """

    def __init__(self, texts: list[str], size: int):
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ends, hashes = tokens("\n".join(texts))
        own = np.searchsorted(bounds, starts, "right") - 1
        n = max(len(starts) - size + 1, 0)
        windows = np.flatnonzero(own[:n] == own[size - 1 :]) if n else np.zeros(0, int)
        self.text = self.first = self.count = self.anchor = np.zeros(0, int)
        if not len(windows):
            return
        inner = max(size // 3, 1)
        parts = rolled(hashes, inner)
        places = leftmost(parts, size - inner + 1)[windows]
        new = np.append(True, (np.diff(places) > 0) | (np.diff(windows) > 1))
        at = np.flatnonzero(new)
        self.whole = windows[at]  # the first window's number in all texts together
        self.text = own[self.whole]
        self.first = self.whole - np.searchsorted(starts, bounds[self.text])
        self.count = np.diff(np.append(at, len(windows)))
        self.anchor = parts[places[at]].view(np.int64)
        self.starts, self.ends, self.size, self.bounds, self.digests = starts, ends, size, bounds, rolled(hashes, size)

    def blobs(self, some: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """Of some stretches: their windows' digests, starts and ends as bytes; places as steps from the one before."""
        digests, starts, ends = [], [], []
        for w, n, t in zip(self.whole[some].tolist(), self.count[some].tolist(), self.text[some].tolist(), strict=True):
            base = self.bounds[t]
            digests.append(self.digests[w : w + n].tobytes())
            starts.append(np.diff(self.starts[w : w + n], prepend=base).astype(np.int32).tobytes())
            ends.append(np.diff(self.ends[w + self.size - 1 : w + self.size - 1 + n], prepend=base).astype(np.int32).tobytes())
        return digests, starts, ends


#: A stretch of windows of a document.
STRETCH = "anchor long, doc_id long, doc_key long, first int, digests binary, starts binary, ends binary"
#: A stretch of words that stands earlier too: from word `unit_no` up to word `to`.
FOUND = "doc_id long, doc_key long, unit_no int, to int, start int, end int, kept_doc_id long, kept_unit_no int"


def unfolded(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The windows of a batch of stretches: row in the batch, first word, start, end, digest."""
    digests = [np.frombuffer(b, np.int64) for b in batch.column("digests").to_pylist()]
    counts = np.fromiter(map(len, digests), np.int64, len(digests))
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = []
    for name in ("starts", "ends"):
        steps = np.frombuffer(b"".join(batch.column(name).to_pylist()), np.int32).astype(np.int64)
        sums = np.cumsum(steps)
        before = np.append(0, sums)[np.cumsum(counts) - counts]
        places.append(sums - np.repeat(before, counts))
    return row, batch.column("first").to_numpy()[row] + within, *places, np.concatenate(digests)


def repeated_in_anchors(size: int):
    """For a map over stretches sorted by anchor and rank: what stands earlier too, all anchors of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in runs(batches, ["anchor"]):
            if batch.num_rows < 2:
                continue
            row, word, start, end, digest = unfolded(batch)
            order = np.argsort(digest, kind="stable")
            new = np.append(True, digest[order][1:] != digest[order][:-1])
            earlier = np.empty(len(order), np.int64)  # the first window of the same digest, in the order of ranks
            earlier[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            key = batch.column("doc_key").to_numpy()[row]
            own = key == key[earlier]
            at = np.flatnonzero(~(own & (word == word[earlier])))
            if not len(at):
                continue
            first = earlier[at]
            over = own[at] & (word[first] + size > word[at])
            since = np.where(over, word[first] + size, word[at])
            begin = np.where(over, end[first], start[at])
            # windows in a row of one stretch make one piece; its kept place is that of where it begins
            cut = np.append(True, (np.diff(at) > 1) | (np.diff(row[at]) > 0))
            piece = np.cumsum(cut) - 1
            doc = batch.column("doc_id")
            kept = since - (word[at] - word[first])
            kept_doc = doc.fill_null(0).to_numpy()[row[first]]
            null = doc.is_null().to_numpy(zero_copy_only=False)[row[first]]
            by_place = np.lexsort((kept, kept_doc, null, since, piece))[np.flatnonzero(cut)]
            last = np.append(np.flatnonzero(cut)[1:], len(at)) - 1
            columns = [
                doc.take(pa.array(row[at[by_place]])), pa.array(key[at[by_place]]), pa.array(since[by_place], pa.int32()),
                pa.array(word[at[last]] + size, pa.int32()), pa.array(begin[by_place], pa.int32()), pa.array(end[at[last]], pa.int32()),
                doc.take(pa.array(row[first[by_place]])),
                pa.array(kept[by_place], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def repeated_of_hot_anchors(stretches: DataFrame, size: int) -> DataFrame:
    """The same for anchors with more stretches than one task should hold: a row a window, partial minima, a join that can be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, word, start, end, digest = unfolded(batch)
            ints = [pa.array(x, pa.int32()) for x in (word, start, end)]
            longs = [batch.column(c).take(pa.array(row)) for c in ("anchor", "doc_id", "doc_key")]
            yield pa.RecordBatch.from_arrays([*longs, *ints, pa.array(digest)], names=["anchor", "doc_id", "doc_key", "word", "start", "end", "digest"])

    rows = stretches.mapInArrow(run, "anchor long, doc_id long, doc_key long, word int, start int, end int, digest long")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key", "word", "end")
    groups = rows.groupBy("anchor", "digest").agg(F.min(rank).alias("kept"), F.count("*").alias("n"))
    again = rows.join(small(written(groups.filter(F.col("n") > 1).drop("n"))), ["anchor", "digest"])
    own = F.col("doc_key") == F.col("kept.doc_key")
    over = own & (F.col("kept.word") + size > F.col("word"))
    since = F.when(over, F.col("kept.word") + size).otherwise(F.col("word"))
    return again.filter(~(own & (F.col("word") == F.col("kept.word")))).select(
        "doc_id",
        "doc_key",
        since.alias("unit_no"),
        (F.col("word") + size).alias("to"),
        F.when(over, F.col("kept.end")).otherwise(F.col("start")).alias("start"),
        "end",
        F.col("kept.doc_id").alias("kept_doc_id"),
        (since - F.col("word") + F.col("kept.word")).alias("kept_unit_no"),
    )


def doc_key(id_col: str, text_col: str):
    """Tells rows apart by id and text, so that documents without id, or of one id with different texts, are not taken for one."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 51, anchor_rows: int = 32_768) -> DataFrame:
    """A row for each passage to remove: doc_id, doc_key (of id and text), unit_no, start, end (code points of the original text,
    end exclusive), n_words, kept_doc_id and kept_unit_no; a unit_no is the number of a passage's first word.

    The units are all runs of min_words words in a row, normalised by folding A-Z and white space. Their digests meet globally,
    the earliest occurrence stays, by doc_id and then by place, and a word goes if any of its runs stands earlier too; runs in a
    row make one passage, whose kept place is that of its first run. A run that overlaps its own earlier place loses only what
    lies beyond. Each letter of a script without blanks is a word.

    Every run is looked for: a run's anchor, the least hash of the parts inside it, stands at two places at least if the run
    does, so digests are needed only where an anchor repeats, and runs in a row travel as one row for each anchor. The rows of
    an anchor meet in one task if they are anchor_rows at most; beyond that, each run is a row of partial minima and of a join
    that Spark can split. Documents without id rank last, then by doc_key; rows that repeat an id and its text are one
    document: they stay or go together. Null texts and texts of fewer words have no runs; an empty table gives an empty one.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    texts = docs.select(*columns).filter(F.col("text").isNotNull()).withColumn("doc_key", doc_key("doc_id", "text"))

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            for at, some in chunks(batch.column(0).to_pylist()):
                found = Stretches(some, min_words)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found.text + at)), pa.array(found.anchor, pa.int64())], names=["doc_key", "anchor"])

    def stretches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            for at, some in chunks(batch.column(2).to_pylist()):
                found = Stretches(some, min_words)
                sets = np.unique(wanted.slice(at, len(some)).flatten().to_numpy(zero_copy_only=False))
                chosen = np.flatnonzero(np.isin(found.anchor, sets))
                own = [batch.column(c).take(pa.array(found.text[chosen] + at)) for c in (0, 1)]
                blobs = [pa.array(b, pa.binary()) for b in found.blobs(chosen)] if len(chosen) else [pa.array([], pa.binary())] * 3
                rows = [pa.array(found.anchor[chosen], pa.int64()), *own, pa.array(found.first[chosen], pa.int32()), *blobs]
                yield pa.RecordBatch.from_arrays(rows, names=[x.split()[0] for x in STRETCH.split(", ")])

    anchors = written(texts.select("text", "doc_key").mapInArrow(anchors_of, "doc_key long, anchor long"))
    counts = written(anchors.groupBy("anchor").count().filter(F.col("count") > 1))
    wanted = anchors.join(counts.select("anchor"), "anchor").groupBy("doc_key").agg(F.collect_set("anchor").alias("anchors"))
    chosen = texts.join(wanted, "doc_key").select("doc_id", "doc_key", "text", "anchors")
    stretches = written(chosen.mapInArrow(stretches_of, STRETCH))
    forget(anchors)
    hot = written(counts.filter(F.col("count") > anchor_rows).select("anchor"))
    rank = ["anchor", F.col("doc_id").isNull(), "doc_id", "doc_key", "first"]
    if hot.take(1):
        rest = stretches.join(small(hot), "anchor", "left_anti")
        again = repeated_of_hot_anchors(stretches.join(small(hot), "anchor", "left_semi"), min_words)
    else:
        rest, again = stretches, None
    found = rest.repartition("anchor").sortWithinPartitions(*rank).mapInArrow(repeated_in_anchors(min_words), FOUND)
    return merged_passages(found if again is None else found.unionByName(again))


def merged_passages(found: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a document as one passage each."""
    by_doc = Window.partitionBy("doc_key").orderBy("unit_no", "to", "start", "kept_doc_id", "kept_unit_no")
    before = F.max("to").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(before.isNull() | (F.col("unit_no") > before), 1).otherwise(0))
    found = found.withColumn("passage", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    source = F.min(F.struct("unit_no", F.col("kept_doc_id").isNull().alias("last"), "kept_doc_id", "kept_unit_no"))
    merged = found.groupBy("doc_key", "passage").agg(
        F.min("doc_id").alias("doc_id"), F.min("unit_no").alias("unit_no"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.max("to").alias("to"), source.alias("source"),
    )
    return merged.select(
        "doc_id", "doc_key", "unit_no", "start", "end", (F.col("to") - F.col("unit_no")).alias("n_words"), "source.kept_doc_id", "source.kept_unit_no"
    )


def without_passages(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed passages cut out of their texts; the other columns and words stay as they are."""
    spans = removed.groupBy(F.col("doc_key").alias("__key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    joined = docs.join(spans, doc_key(id_col, text_col) == F.col("__key"), "left")
    return joined.withColumn(text_col, without_spans(text_col, "__spans", 0)).select(*docs.columns)
