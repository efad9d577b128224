"""Language identification by words first, with a backoff to ever shorter character n-grams."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taktwerk.llm.common import BASE, chunks, map_column, mixed, rolled

UNKNOWN = "und"
# Code points beyond all letters, which mark where a word begins and ends.
BEGIN, END = 0x110000, 0x110001


@lru_cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it can stand in a word (letters, and signs that count as such, but no digits), and whether it is a letter."""
    word, letter = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        word[i] = c.isalnum() and not c.isdecimal()
        letter[i] = unicodedata.category(c)[0] == "L"
    return word, letter


class Words:
    """The words of some texts in lower case, in order: text (its number), start and end in `points`, hash."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        self.points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        bounds = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        word, letter = classes()
        inside = word[self.points]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(bounds, self.start, "right") - 1
        self.letters = np.zeros(len(texts), bool)
        self.letters[np.searchsorted(bounds, np.flatnonzero(letter[self.points]), "right") - 1] = True
        self.hash = np.zeros(0, np.uint64)
        if len(self.start):
            place = np.where(inside, np.arange(len(inside)) - self.start[np.maximum(np.cumsum(first) - 1, 0)], 0)
            powers = np.cumprod(np.full(int(place.max()) + 1, BASE))
            terms = np.where(inside, mixed(self.points.astype(np.uint64) + BASE) * powers[place], np.uint64(0))
            self.hash = mixed(np.add.reduceat(terms, self.start) + (self.end - self.start).astype(np.uint64))


def grams(words: Words, some: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of some words: hashes of their n-grams, borders marked, with the word's number among them; no gram is a border alone."""
    length = words.end[some] - words.start[some] + 2
    own = np.repeat(np.arange(len(some)), length)
    ends = np.cumsum(length)
    within = np.arange(len(own)) - np.repeat(ends - length, length)
    points = np.full(len(own), END)
    inner = (within > 0) & (within < length[own] - 1)
    points[inner] = words.points[words.start[some][own[inner]] + within[inner] - 1]
    points[within == 0] = BEGIN
    if len(points) < n:
        return np.zeros(0, np.uint64), own[:0]
    whole = own[: len(own) - n + 1] == own[n - 1 :]
    if n == 1:
        whole &= inner
    return rolled(mixed(points.astype(np.uint64) + BASE), n)[whole], own[: len(own) - n + 1][whole]


def counted(texts: DataFrame, langs: list[str], order: int) -> DataFrame:
    """(n, hash, lang, count) of words (n = 0) and their n-grams up to `order`, lang as its place in langs; tasks sum before rows move."""
    at = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[int, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(at[lang], []).append(text)
            for lang, own in by_lang.items():
                for _, some in chunks(own):
                    words = Words(some)
                    found, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
                    yield table(0, found, lang, counts)
                    for n in range(1, order + 1):
                        hashes, word = grams(words, first, n)
                        different, to = np.unique(hashes, return_inverse=True)
                        yield table(n, different, lang, np.bincount(to, counts[word], len(different)))

    def table(n: int, hashes: np.ndarray, lang: int, counts: np.ndarray) -> pa.RecordBatch:
        same = [pa.array(np.full(len(hashes), x), pa.int32()) for x in (n, lang)]
        arrays = [same[0], pa.array(hashes.view(np.int64)), same[1], pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "hash", "lang", "count"])

    found = texts.mapInArrow(run, "n int, hash long, lang int, count long")
    return found.groupBy("n", "hash", "lang").agg(F.sum("count").alias("count"))


class LanguageModel:
    """Log frequencies by language of words and n-grams, as sorted arrays of hashes; scores are sums over the words of a text."""

    def __init__(self, rows: pa.Table, prior: dict[str, int], order: int = 5):
        """rows: the columns n, hash, lang (its place among the sorted languages of prior) and count, in that order."""
        self.langs, self.order = sorted(prior), order
        k = len(self.langs)
        n, hashes, lang, count = (c.to_numpy() for c in rows.columns)
        self.hashes, self.logs = [], []
        for size in range(order + 1):
            own = n == size
            found, to = np.unique(hashes[own].view(np.uint64), return_inverse=True)
            counts = np.zeros((len(found), k))
            np.add.at(counts, (to, lang[own]), count[own])
            self.hashes.append(found)
            self.logs.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(found) + 1))).astype(np.float32))
        total = sum(prior.values())
        self.prior = np.array([math.log((prior[lang] + 1) / (total + k)) for lang in self.langs])

    def look(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of hashes in the table of n, and which of them are there."""
        known = self.hashes[n]
        if not len(known):
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return at, known[at] == hashes

    def word_scores(self, words: Words, some: np.ndarray) -> np.ndarray:
        """A row for each of some words: its log frequencies; for an unseen one the mean over its longest known n-grams, else 0."""
        out = np.zeros((len(some), len(self.langs)))
        at, known = self.look(0, words.hash[some])
        out[known] = self.logs[0][at[known]]
        open_words = np.flatnonzero(~known)
        for n in range(self.order, 0, -1):
            if not len(open_words):
                break
            hashes, word = grams(words, some[open_words], n)
            at, known = self.look(n, hashes)
            at, word = at[known], word[known]
            found = np.bincount(word, minlength=len(open_words))
            sums = [np.bincount(word, self.logs[n][at, k], len(open_words)) for k in range(len(self.langs))]
            done = found > 0
            out[open_words[done]] = np.array(sums).T[done] / found[done, None]
            open_words = open_words[~done]
        return out

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the likelihood; und and 0 without a letter or a model."""
        langs, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for base, some in chunks([t or "" for t in texts]) if self.langs else ():
            words = Words(some)
            different, first, to = np.unique(words.hash, return_index=True, return_inverse=True)
            totals = np.tile(self.prior, (len(some), 1))
            if len(different):
                at = np.flatnonzero(np.append(True, np.diff(words.text) > 0))
                totals[words.text[at]] += np.add.reduceat(self.word_scores(words, first)[to], at)
            likely = np.exp(totals - totals.max(axis=1, keepdims=True))
            best = likely.argmax(axis=1)
            share = likely[np.arange(len(some)), best] / likely.sum(axis=1)
            for i in np.flatnonzero(words.letters).tolist():
                langs[base + i], shares[base + i] = self.langs[best[i]], float(share[i])
        return langs, shares

    def predict(self, text: str | None) -> tuple[str, float]:
        (lang,), (share,) = self.predict_all([text])
        return lang, share


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 2_000, order: int = 5) -> LanguageModel:
    """Fits a model to the labelled rows; rows without text or language are left out.

    Equal texts of a language count once. The fit takes about max_docs of the rest: all of a language that has no more than its
    equal share, and of the others, by a hash of their text, as many each as then have room. The prior counts all different
    texts. Every word and n-gram of what is taken is learned. Without rows the model knows no language and predicts und.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    prior = {r.lang: r["count"] for r in rows.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    room, share = max_docs, {}
    for left, lang in zip(range(len(prior), 0, -1), sorted(prior, key=lambda x: (prior[x], x)), strict=True):
        share[lang] = min(prior[lang], max(room // left, 1))
        room -= share[lang]
    parts = [F.lit(v) for x, n in share.items() if n < prior[x] for v in (x, int((1 << 40) * n / prior[x]))]
    if parts:
        limit = F.coalesce(F.create_map(*parts)[F.col("lang")], F.lit(1 << 40))
        rows = rows.filter(F.pmod("hash", F.lit(1 << 40)) < limit)
    rows = rows.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("text", "lang")
    return LanguageModel(counted(rows, sorted(prior), order).toArrow(), prior, order)


def identify(docs: DataFrame, keep: list[str], model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Carries `keep` and adds lang_pred and score (0 to 1) for every whole text, in one pass without a shuffle.

    A null text, or one without a letter, is und with score 0. A text whose words tell nothing gets the most
    frequent language of the training rows, with that language's share as score; of equally likely languages the first by
    name is taken. Repeated rows are predicted each; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def setup():
        def work(texts: list) -> dict[str, list]:
            langs, shares = shared.value.predict_all(texts)
            return {"lang_pred": langs, "score": shares}

        return work

    return map_column(docs, text_col, keep, fields, setup)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_on_documents(docs: DataFrame) -> LanguageModel:
    """The model of the documents that have an id and are not held out."""
    return train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
