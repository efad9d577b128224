"""Source divergence audit: how the sources of a language differ in their words, by integer-dictionary encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import runs, small, written
from taktwerk.llm.words import WORD, Words, kinds, parts

LETTERS = kinds(bytes(c for c in range(128) if not chr(c).isalpha()))
SCALE = 1_000_000_000
CHUNK_TERMS = 1 << 14  # kept terms of a chunk
CELLS = 1 << 21  # numbers of a dense block of vectors
TOP = 10
assert LETTERS[ord("a")] == WORD

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
ENCODED = pa.schema(
    [("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))]
)
COMPARED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of a part of the rows: its terms with their occurrences and documents, and a row without term."""
    for part in parts(batches, "text"):
        words = Words(part.column("text").to_pylist(), LETTERS)
        number: dict[tuple, int] = {}
        pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
        group = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
        n_terms = max(len(words.terms), 1)
        keys, n = np.unique(group[words.text] * n_terms + words.ids, return_counts=True)
        in_doc = np.unique(words.text * n_terms + words.ids)
        docs = np.unique(group[in_doc // n_terms] * n_terms + in_doc % n_terms, return_counts=True)[1]
        of = np.append(keys // n_terms, np.arange(len(number)))
        term = words.terms.take(pa.array(np.append(keys % n_terms, np.zeros(len(number), np.int64)), mask=np.append(np.zeros(len(keys), bool), np.ones(len(number), bool))))
        names = pa.array(list(number), pa.list_(pa.string(), 2)).flatten()
        zeros = np.zeros(len(number), np.int64)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(2 * of)), names.take(pa.array(2 * of + 1)), term.cast(pa.large_string()).cast(pa.string()), pa.array(np.append(n, zeros)), pa.array(np.append(docs, zeros))],
            schema=COUNTED,
        )


def encoder(min_docs: int, chunk_terms: int):
    """Turns cells, sorted by language and term, into chunks: the sorted array of kept terms, and for each source its ids and counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray, list, np.ndarray]] = []
        lang, size = None, 0

        def chunk() -> pa.RecordBatch:
            kept = np.concatenate([h[0] for h in held])  # sorted, as the rows are
            ids = np.concatenate([np.repeat(np.searchsorted(kept, terms), rows) for terms, rows, _, _ in held])
            sources = [s for h in held for s in h[2]]
            counts = np.concatenate([h[3] for h in held])
            number = {s: i for i, s in enumerate(sorted(set(sources)))}
            group = np.array([number[s] for s in sources], np.int64)
            order = np.lexsort((ids, group))
            cuts = np.append(0, np.cumsum(np.bincount(group, minlength=len(number))))
            rows = [(s, ids[order[a:b]], counts[order[a:b]]) for s, a, b in zip(number, cuts[:-1], cuts[1:], strict=True)]
            n = len(rows) + 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([base + made] * n, pa.int64()),
                    pa.array([None, *(r[0] for r in rows)], pa.string()),
                    pa.array([None, *(r[1] for r in rows)], ENCODED.field("ids").type),
                    pa.array([None, *(r[2] for r in rows)], ENCODED.field("counts").type),
                    pa.array([[t.decode() for t in kept], *[None] * len(rows)], ENCODED.field("terms").type),
                ],
                schema=ENCODED,
            )

        for batch, at in runs(batches, ["lang", "term"]):
            n_docs = np.add.reduceat(batch.column("docs").to_numpy(), at[:-1])
            langs = batch.column("lang").take(pa.array(at[:-1])).to_pylist()
            terms = batch.column("term").take(pa.array(at[:-1])).cast(pa.binary()).to_pylist()
            sources, counts, rows = batch.column("source").to_pylist(), batch.column("n").to_numpy(), np.diff(at)
            for k in np.flatnonzero(n_docs >= min_docs):
                if held and (langs[k] != lang or size >= chunk_terms):
                    yield chunk()
                    held, size, made = [], 0, made + 1
                lang, size = langs[k], size + 1
                one = np.empty(1, object)
                one[0] = terms[k]
                held.append((one, rows[k : k + 1], sources[at[k] : at[k + 1]], counts[at[k] : at[k + 1]]))
        if held:
            yield chunk()

    return encode


def shares(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * n_terms)), by long division, so that nothing passes 64 bits."""
    d = total + 2 * n_terms
    out, rest = np.divmod(counts + 2, d)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compare(key: tuple, table: pa.Table) -> pa.Table:
    """For a chunk of a language: each pair of sources with its sum over the chunk, each source with its best terms."""
    lang = key[0].as_py()
    rows = table.select(["source", "total", "lang_total", "n_terms", "ids", "counts"]).filter(pa.compute.is_valid(table["source"])).to_pydict()
    terms = next((t for t in table["terms"].to_pylist() if t is not None), [])
    sources, size = rows["source"], len(terms)
    vectors = [(np.array(i or [], np.int64), np.array(c or [], np.int64)) for i, c in zip(rows["ids"], rows["counts"], strict=True)]
    out: list[tuple] = []
    if size:
        n_terms, lang_total = rows["n_terms"][0], rows["lang_total"][0]
        whole = np.zeros(size, np.int64)
        for ids, counts in vectors:
            whole[ids] += counts
        q = shares(whole, lang_total, n_terms)
        for source, total, (ids, counts) in zip(sources, rows["total"], vectors, strict=True):
            p = shares(counts, total, n_terms)
            over = p > q[ids]
            value, own = divergence(p[over], q[ids[over]]), ids[over]
            best = np.lexsort((own, -value))[:TOP]  # ids are in UTF-8 order
            out += [(source, "term", terms[i], int(v)) for i, v in zip(own[best], value[best], strict=True)]

    def dense(a: int, b: int) -> np.ndarray:
        block = np.zeros((b - a, size), np.int64)
        for row, (ids, counts) in zip(block, vectors[a:b], strict=True):
            row[ids] = counts
        return np.stack([shares(row, t, n_terms) for row, t in zip(block, rows["total"][a:b], strict=True)])

    step = max(CELLS // max(size, 1), 1)
    for a in range(0, len(sources), step):
        left = dense(a, min(a + step, len(sources))) if size else None
        for b in range(a, len(sources), step):
            right = left if a == b else dense(b, min(b + step, len(sources))) if size else None
            for i in range(a, min(a + step, len(sources))):
                first = max(b, i + 1)
                others = sources[first : b + step]
                sums = divergence(left[i - a], right[first - b :]).sum(axis=1).tolist() if size else [0] * len(others)
                out += [(sources[i], "pair", o, v) for o, v in zip(others, sums, strict=True)]
                out += [(o, "pair", sources[i], v) for o, v in zip(others, sums, strict=True)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(COMPARED)[1:], strict=True))], schema=COMPARED)


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, chunk_terms: int = CHUNK_TERMS
) -> DataFrame:
    """How far the sources of each language lie apart, and which terms set a source apart from its language.

    Terms are runs of letters (any byte above ASCII is one), A-Z folded. A language keeps the terms that min_docs of its documents
    hold. A share is 1 + floor(10^9 * (count + 2) / (N + 2V)), a divergence floor((p - q)^2 / (p + q)), all in integers.
    Returns (lang, source, part, item, value, rank): part `pair` has every other source of the language with the sum over all kept
    terms, `term` the ten terms of most divergence among those that the source holds more of than its language.

    The texts are read once. Counts by (lang, source, term) add up in each part of a task, in Spark and in a table; sorted by
    term and cut into chunks of kept terms, they become ids in sorted arrays, so that ids stand for UTF-8 order. Each chunk of
    a language is compared by itself, sources in dense blocks; sums and best terms of the chunks are put together at the end.
    No group is larger than a chunk times the sources of a language.

    Null languages, sources and texts are empty ones. A source without kept terms has pairs all the same; a language without
    kept terms has pairs of value 0. Repeated documents count each; no documents give no rows. Ties go by item in UTF-8 order.
    """
    empty = F.lit("")
    rows = docs.select(
        *(F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), F.col(text_col).cast("binary").alias("text")
    )
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    cells = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    ordered = cells.filter(F.col("term").isNotNull()).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    schema = "lang string, chunk long, source string, ids array<int>, counts array<long>, terms array<string>"
    chunks = written(ordered.mapInArrow(encoder(min_docs, chunk_terms), schema))

    dictionary = chunks.filter(F.col("source").isNull()).select("lang", "chunk", "terms")
    sums = F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    totals = chunks.filter(F.col("source").isNotNull()).groupBy("lang", "source").agg(sums.alias("total"))
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    n_terms = dictionary.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    groups = cells.filter(F.col("term").isNull()).select("lang", "source")
    groups = groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").join(n_terms, "lang", "left")
    groups = small(written(groups.na.fill(0, ["total", "lang_total", "n_terms"])))
    no_terms = cells.filter(F.col("term").isNull()).select("lang", F.lit(-1).cast("long").alias("chunk")).distinct()
    all_chunks = dictionary.select("lang", "chunk").unionByName(no_terms)
    vectors = chunks.filter(F.col("source").isNotNull()).select("lang", "chunk", "source", "ids", "counts")
    members = all_chunks.join(groups, "lang").join(vectors, ["lang", "chunk", "source"], "left").withColumn("terms", F.lit(None).cast("array<string>"))
    members = members.unionByName(dictionary, allowMissingColumns=True)
    found = members.groupBy("lang", "chunk").applyInArrow(compare, "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(order))
    return found.filter((F.col("part") == "pair") | (F.col("rank") <= TOP))
