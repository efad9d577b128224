"""Substring dedup by hashing lines or paragraphs: the earliest occurrence stays, with its offsets on record."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import written

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
# What parts the units of a text.
PARTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\t\r]*\n\s*")}


def units(text: str, unit: str = "line", min_words: int = 5) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(unit_no, start, end, words, digest) of each unit of min_words words or more; offsets in code points.

    A unit is normalised by folding A-Z and runs of white space; its offsets are those of the original text.
    """
    at = number = 0
    bounds = [(m.start(), m.end()) for m in PARTS[unit].finditer(text)]
    for end, after in [*bounds, (len(text), len(text))]:
        words = text[at:end].translate(LOWER).split()
        if len(words) >= min_words:
            digest = hashlib.md5(" ".join(words).encode(), usedforsecurity=False).digest()
            yield number, at, end, len(words), digest
        at = after
        number += 1


def unit_table(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """A row for each unit: doc_id, unit_no, start, end, n_words, digest (two longs)."""
    schema = "doc_id long, unit_no int, start int, end int, n_words int, d1 long, d2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, start, end, words, digest in units(text or "", unit, min_words):
                    d1 = int.from_bytes(digest[:8], "big", signed=True)
                    d2 = int.from_bytes(digest[8:], "big", signed=True)
                    for c, v in zip(columns, (doc, number, start, end, words, d1, d2), strict=True):
                        c.append(v)
            types = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "unit_no", "start", "end", "n_words", "d1", "d2"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 5
) -> DataFrame:
    """A row for each unit to remove: doc_id, unit_no, start, end (code points of the original text, end exclusive),
    n_words, kept_doc_id and kept_unit_no, which tell the occurrence that stays.

    Occurrences rank by doc_id, then by place; the first of a digest stays, in its own document too. Units
    of fewer than min_words words are never removed. Digests meet as partial minima, one row a key and task;
    only digests that occur more than once are joined back, so a line that a third of all documents share
    costs one row there, and Spark splits its rows on the other side. Null texts have no units; a document
    without id ranks last, and such documents count as one; rows repeated under one id have equal ranks and
    stay or go together.
    """
    rows = written(unit_table(docs, id_col, text_col, unit, min_words))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "unit_no")
    groups = rows.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("final"))
    kept = written(
        groups.filter(F.col("first") != F.col("final")).select(
            "d1", "d2", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.unit_no").alias("kept_unit_no")
        )
    )
    again = rows.join(kept, ["d1", "d2"])
    first = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("unit_no") == F.col("kept_unit_no"))
    return again.filter(~first).select("doc_id", "unit_no", "start", "end", "n_words", "kept_doc_id", "kept_unit_no")


def without_spans(text_col: str, spans_col: str, after: int):
    """An expression: the text without the spans, which are sorted by start, and without `after` letters behind each."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(acc, span):
        piece = F.substring(F.col(text_col), acc["at"] + 1, span["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], piece).alias("out"), (span["end"] + after).alias("at"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.lit(2**31 - 1)))

    return F.when(F.col(spans_col).isNull(), F.col(text_col)).otherwise(F.aggregate(F.col(spans_col), empty, cut, finish))


def without_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed units cut out of their texts, each with the line break after it; a document's other columns and
    units stay as they are. Documents without an id are matched to removed units without one.
    """
    spans = removed.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("__id")), "left")
    return joined.withColumn(text_col, without_spans(text_col, "__spans", 1)).select(*docs.columns)
