"""Phrase collocations: generalised suffix automata of bounded depth for each shard, counts reduced over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import BASE, forget, mixed, small, written
from taktwerk.llm.words import Words, kinds, parts

WORDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
DEPTH = 4
MAX_BITS = 1 << 28  # of a filter: 32 MB, whatever the corpus
BITS_EACH = 16  # of a filter, for each phrase in it, up to MAX_BITS
SALTS = 32
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


class Automaton:
    """A generalised suffix automaton of pieces of words, of bounded depth, as arrays.

    Level d names the different runs of d words; a run's name and its next word lead to the name of the longer run, and its link to the
    run without the first word. Runs that end at the same places are one state, named by the longest of them: it stands for
    its suffixes of `shortest` words or more. endpos counts how many places those are.
    """

    def __init__(self, ids: np.ndarray, piece: np.ndarray, depth: int):
        n = len(ids)
        n_words = int(ids.max(initial=0)) + 1
        self.first: list[np.ndarray] = []  # where a run of each name starts, somewhere
        self.endpos: list[np.ndarray] = []
        self.link: list[np.ndarray] = []
        self.shortest: list[np.ndarray] = []
        self.longest: list[np.ndarray] = []  # whether a run is the longest of its state
        name = np.zeros(0, np.int64)
        for d in range(1, depth + 1):
            at = np.arange(n) if d == 1 else np.flatnonzero(piece[: n - d + 1] == piece[d - 1 :]) if n >= d else np.arange(0)
            step = ids if d == 1 else name[at] * n_words + ids[at + d - 1]
            _, first, named, count = np.unique(step, return_index=True, return_inverse=True, return_counts=True)
            first = at[first]
            if d == 1:
                link, shortest = np.zeros(len(first), np.int64), np.ones(len(first), np.int64)
            else:
                link = name[first + 1]
                same = self.endpos[-1][link] == count  # every run of the link is the end of one of these
                self.longest[-1][link[same]] = False
                shortest = np.where(same, self.shortest[-1][link], d)
            self.first.append(first)
            self.endpos.append(count)
            self.link.append(link)
            self.shortest.append(shortest)
            self.longest.append(np.ones(len(first), bool))
            name = np.full(n, -1, np.int64)
            name[at] = named

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each different run of `length` words starts, somewhere, and how often it occurs: from the states that hold one."""
        starts, counts = [], []
        for d in range(length, len(self.first) + 1):
            holds = self.longest[d - 1] & (self.shortest[d - 1] <= length)
            starts.append(self.first[d - 1][holds] + d - length)
            counts.append(self.endpos[d - 1][holds])
        return np.concatenate(starts), np.concatenate(counts)


def language_hash(lang: str) -> np.ndarray:
    return hashed([lang.encode()])


def hashed(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def longer(start: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run and one more word."""
    return mixed(start * BASE + word)


class Filter:
    """A Bloom filter over phrases, of bounded size. It may pass a phrase that isn't in it, which costs a counted row; never the reverse."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return hashes & mask, mixed(hashes + BASE) & mask

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in self.places(hashes, self.mask):
            out &= (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return out


def filter_of(phrases: DataFrame, max_bits: int = MAX_BITS) -> Broadcast:
    """A broadcast filter over (lang, phrase): its bits are gathered by Spark, at most max_bits of them."""
    n = phrases.count()
    bits = max(min(1 << (max(n * BITS_EACH, 1) - 1).bit_length(), max_bits), 64)
    mask = np.uint64(bits - 1)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                h = language_hash(lang)
                for w in hashed(phrase.encode().split(b" ")):
                    h = longer(h, w)
                found.append(h)
            p = np.concatenate(Filter.places(np.concatenate(found), mask)) if found else np.zeros(0, np.uint64)
            slots, of = np.unique((p >> np.uint64(6)).astype(np.int64), return_inverse=True)
            own = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(own, of, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(own.view(np.int64))], names=["slot", "bits"])

    rows = phrases.mapInArrow(set_bits, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(bits // 64, np.uint64)
    filled[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(filled)


def counter(lengths: range, known: Broadcast | None):
    """Counts the runs of these lengths in each shard, by language: about 8 MB of text.

    known: a filter over all frequent runs of one word less than the least length, one or two words. Pieces end where a word, or a
    pair of words, isn't in it, as no frequent run goes on there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Filter(known.value) if known is not None else None
        for part in parts(batches, "text"):
            langs = part.column("lang").dictionary_encode()
            of = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words = Words(part.column("text").take(pa.array(np.flatnonzero(of == k))).to_pylist(), WORDS)
                ids, piece = words.ids, words.piece
                if passes is not None:
                    own = hashed(words.terms.to_pylist())
                    if lengths.start == 2:
                        frequent = passes(longer(language_hash(lang), own))[ids]
                        piece = (piece + np.cumsum(~frequent))[frequent]
                        ids = ids[frequent]
                    else:
                        together = passes(longer(longer(language_hash(lang), own[ids[:-1]]), own[ids[1:]]))
                        piece = piece + np.append(0, np.cumsum(~together))
                        cuts = np.flatnonzero(np.diff(piece)) + 1
                        sizes = np.diff(np.concatenate([[0], cuts, [len(ids)]]))
                        long = np.repeat(sizes >= lengths.start, sizes)
                        ids, piece = ids[long], piece[long]
                automaton = Automaton(ids, piece, lengths.stop - 1)
                for length in lengths:
                    starts, counts = automaton.runs(length)
                    if len(starts):
                        columns = [words.terms.take(pa.array(ids[starts + j])) for j in range(length)]
                        phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if length > 1 else columns[0]
                        for a in range(0, len(starts), 10_000):
                            text = phrase.slice(a, 10_000).cast(pa.large_string()).cast(pa.string())
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), text, pa.array(counts[a : a + 10_000])], schema=COUNTED)

    return count


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 30,
    top: int = 2000,
    subsumed_percent: int = 80,
    scale: int = 2_000_000,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The best phrases of two to four words of each language: (lang, rank, phrase, a, l, r, n, score).

    Words are parted by blanks and tabs, A-Z folded; phrases don't cross . , ; : ! ? or a line's end. a is how often a phrase occurs, at
    least `least` times; a cut leaves two parts that occur l and r times and scores floor(scale * a / (l + r)); the cut that scores least counts,
    of equal ones that after fewest words. A phrase goes if its words lie inside a longer one that occurs at least subsumed_percent as
    often; as such a longer phrase makes one of one word more that does, only those are looked at: the phrase without its last
    word, and its suffix link. `top` phrases of a language stay, by score, then a, then phrase in UTF-8 order.

    The texts are read three times: words, then pairs of frequent words, then phrases of frequent pairs. Each shard of a task, some 8 MB
    of a language's text, gives an automaton whose runs are counted; the counts add up in Spark, and only frequent runs stay. What
    passes from one reading to the next is a filter of max_bits at most; beyond its size it passes more runs that are counted in vain,
    and results stay the same. The best of a language come from SALTS parts of its phrases.

    A null language is `und`, a null text is empty; no texts, or none that is frequent, give no rows; repeated rows count each; a piece
    of any length stays whole in one shard.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def counted(lengths: range, known: Broadcast | None) -> DataFrame:
        return rows.mapInArrow(counter(lengths, known), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))

    words = written(counted(range(1, 2), None))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    singles = words.filter(F.col("f") >= least)
    known = filter_of(singles, max_bits)
    pairs = written(counted(range(2, 3), known).filter(F.col("f") >= least))
    known.destroy()
    known = filter_of(pairs, max_bits)
    longer_ones = written(counted(range(3, DEPTH + 1), known).filter(F.col("f") >= least))
    known.destroy()

    found = pairs.unionByName(longer_ones).withColumnRenamed("f", "a")
    counts = found.withColumnRenamed("a", "f").unionByName(singles)
    w = F.split("phrase", " ", -1)
    size = F.size(w)

    def between(start, length):
        return F.array_join(F.slice(w, start, length), " ")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": between(F.lit(1), F.col("k")), "right": between(F.col("k") + 1, size - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"cast((cast({scale} as decimal(20, 0)) * cast(a as decimal(18, 0))) div cast(l + r as decimal(38, 0)) as bigint)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inside = found.filter(size > 2).withColumn("phrase", F.explode(F.array(between(F.lit(1), size - 1), between(F.lit(2), size - 1))))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    wide = "decimal(20, 0)"
    subsumed = F.lit(100).cast(wide) * F.col("around").cast(wide) >= F.lit(subsumed_percent).cast(wide) * F.col("a").cast(wide)
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(subsumed, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    out = written(best.join(small(written(n)), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for table in (words, pairs, longer_ones):
        forget(table)
    return out
