"""SimHash near-dedup whose candidates must pass a pigeonring filter on five segments of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taktwerk.llm.common import deal, forget, heavy_keys, map_column, runs, written
from taktwerk.llm.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = np.array([[value >> bit & 1 for bit in range(8)] for value in range(256)], np.int64)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits: bit b is set if it is set in over half the hashes of the text's word shingles; 0 without words.

    Words are what ASCII white space parts, A-Z in lower case; fewer words than a shingle make one shingle.
    """
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1].tolist()
    hashes = [hash64(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    result = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ BITS
        for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
            result |= 1 << (8 * k + bit)
    return result


class Ring:
    """The segments of a fingerprint as a ring, for links at up to `budget` differing bits.

    Pigeonring: if two fingerprints differ in at most `budget` bits, then some segment starts a chain whose
    every prefix of l segments differs in at most l * budget / m bits. With m = budget + 1 segments the first
    one agrees and the first two differ in one bit at most; that is what the join key holds.
    """

    def __init__(self, budget: int):
        self.m, self.budget = budget + 1, budget
        base, more = divmod(64, self.m)
        width = [base + (i < more) for i in range(self.m)]
        low = np.cumsum([0, *width])
        self.pairs = []  # of each start: low and width of its own segment and of the next
        self.chains = []  # of each start: (mask, allowed) of the prefixes of 3 and more segments
        masks = [((1 << width[i]) - 1) << int(low[i]) for i in range(self.m)]
        for i in range(self.m):
            j = (i + 1) % self.m
            self.pairs.append((int(low[i]), width[i], int(low[j]), width[j]))
            chain, steps = masks[i] | masks[j], []
            for size in range(3, self.m + 1):
                chain |= masks[(i + size - 1) % self.m]
                steps.append((np.uint64(chain), size * budget // self.m))
            self.chains.append(steps)

    def keys(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """The keys of the prints: exact ones, and those with one bit of the chain's second segment flipped."""
        for i, (low, width, low2, width2) in enumerate(self.pairs):
            one = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
            two = (prints >> np.uint64(low2)) & np.uint64((1 << width2) - 1)
            key = (np.uint64(i) << np.uint64(width + width2)) | (one << np.uint64(width2)) | two
            key |= np.uint64(i) << np.uint64(58)
            yield key, True
            for bit in range(width2):
                yield key ^ np.uint64(1 << bit), False

    def linked(self, start: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of a fingerprint of a with one of b link: chains first, then all 64 bits."""
        differ = a[:, None] ^ b[None, :]
        alive = np.ones(differ.shape, bool)
        for mask, allowed in self.chains[start]:
            alive[alive] = np.bitwise_count(differ[alive] & mask) <= allowed
        alive[alive] = np.bitwise_count(differ[alive]) <= self.budget
        return alive


def similar_prints(prints: DataFrame, budget: int = 4, block_rows: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect whatever differs in `budget` bits or fewer.

    Every linked pair is compared under some key; a key's group emits a star for each of its components,
    so the edges of a group are fewer than its rows. Groups beyond block_rows are dealt over block pairs.
    """
    ring = Ring(budget)
    schema = "key long, fp long, exact boolean"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for key, exact in ring.keys(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0), pa.array(np.full(len(fp), exact))], names=["key", "fp", "exact"]
                )

    keyed = prints.select("fp").mapInArrow(spread, schema)
    heavy = heavy_keys(keyed, "key", block_rows)  # of all rows, as a key of few exact ones may lie beside a hot one
    rows = deal(keyed, "key", "fp", heavy)
    group = ["key", "block_i", "block_j"]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in runs(batches, group):
            exact = batch.column("exact").to_numpy(zero_copy_only=False)
            many = np.diff(at) > 1
            many &= np.add.reduceat(exact, at[:-1]) > 0
            fp, block = (batch.column(c).to_numpy() for c in ("fp", "block"))
            keys = batch.column("key").to_numpy()
            a, b = [], []
            for g in np.flatnonzero(many).tolist():
                s, e = int(at[g]), int(at[g + 1])
                one, own = fp[s:e].view(np.uint64), exact[s:e]
                for x, y in connect(ring, int(keys[s]) >> 58, one, own, block[s:e]):
                    a.append(fp[s + x])
                    b.append(fp[s + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(edges, "a long, b long")


def connect(ring: Ring, start: int, fp: np.ndarray, exact: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Star edges between the rows of one key: exact rows against all rows, one side of a block pair against the other."""
    if len(fp) == 2:
        return [(0, 1)] if ring.linked(start, fp[:1], fp[1:])[0, 0] else []
    inside = np.flatnonzero(exact)
    edges: list[tuple[int, int]] = []
    across = bool((block != block[0]).any())
    step = max(1, 4_000_000 // len(fp))
    parent = np.arange(len(fp))
    for k in range(0, len(inside), step):
        rows = inside[k : k + step]
        links = ring.linked(start, fp[rows], fp)
        if across:
            links &= block[rows][:, None] != block[None, :]
        links[np.arange(len(rows)), rows] = False
        if not links.any():
            continue
        # rows and columns as the two sides of a graph; labels settle on the smallest column reached
        while True:
            best = np.where(links, parent[None, :], len(fp)).min(axis=1)
            best = np.minimum(best, parent[rows])
            back = np.where(links, best[:, None], len(fp)).min(axis=0)
            new = np.minimum(parent, back)
            new[rows] = np.minimum(new[rows], best)
            np.minimum.at(new, parent, new)  # what hung on the old label stays with it
            new = new[new]
            if (new == parent).all():
                break
            parent = new
        touched = np.flatnonzero(parent != np.arange(len(fp)))
        edges += zip(touched.tolist(), parent[touched].tolist(), strict=True)
    return edges


def simhash_prints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Carries `keep` and adds fp, the fingerprint as a signed long. Null and wordless texts get 0."""

    def setup():
        def work(texts: list) -> dict[str, list]:
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return {"fp": prints.view(np.int64)}

        return work

    return map_column(docs, text_col, keep, [T.StructField("fp", T.LongType())], setup, binary=True)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, shingle: int = 4
) -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the smallest id that links reach.

    Fingerprints link at `budget` or fewer differing bits, found without loss. Equal fingerprints collapse
    first, so a group of exact copies costs one row; fingerprints, not documents, are the nodes of the graph.
    A null id takes part through its fingerprint and gets the smallest id of its component, null if that has
    none. Repeated rows get a row each. An empty table gives an empty table.
    """
    prints = written(simhash_prints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), ["id"], "t", shingle))
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least_id")))
    parts = connected_components(similar_prints(nodes, budget))
    found = nodes.join(parts.withColumnRenamed("node", "fp"), "fp")
    least = found.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_print = written(
        nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
        .join(least, "component", "left")
        .select("fp", F.when(F.col("component").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    )
    forget(nodes)
    forget(parts)
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
