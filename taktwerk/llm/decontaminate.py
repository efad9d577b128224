"""Benchmark decontamination with a generalised suffix automaton over the words of all test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taktwerk.llm.common import apart, forget, map_column, written

# One table from byte to byte: A-Z to a-z, everything of ASCII but letters and digits to a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # the same words in a text that still has capitals


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Every run of words of every item is a path from state 0; link leads to the next shorter suffix class.

    window: words of a window; an item of fewer words, but not none, is one window itself.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(i, [number(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n = len(self.next)
        # window_items[s]: items with the window that ends the runs of s; short_items[s]: whole short items among the runs of s
        self.window_items: list[frozenset | None] = [None] * n
        self.short_items: list[list[tuple[int, str | None]] | None] = [None] * n
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=0)
        found: dict[int, set] = {}
        for item, ids in coded:
            if len(ids) < window:
                s = self._walk(ids)
                self.short_items[s] = [*(self.short_items[s] or []), (len(ids), item)]
                continue
            for state, _ in self.matches(ids, window):
                found.setdefault(state, set()).add(item)
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.window_items[s] = frozenset(found.get(s, ())) if self.length[up] < window else self.window_items[up]
        self.short_up = [-1] * n  # the nearest suffix class, s itself included, that holds a short item
        for s in sorted(range(n), key=self.length.__getitem__):
            self.short_up[s] = s if self.short_items[s] else self.short_up[self.link[s]] if s else -1
        self.window = window

    def _extend(self, last: int, c: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(c)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, c, known)
        new = self._state({}, length[last] + 1)
        while last >= 0 and c not in nexts[last]:
            nexts[last][c] = new
            last = link[last]
        if last < 0:
            link[new] = 0
            return new
        known = nexts[last][c]
        link[new] = known if length[known] == length[last] + 1 else self._split(last, c, known)
        return new

    def _state(self, nexts: dict[int, int], length: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, last: int, c: int, known: int) -> int:
        """Part the shorter runs of state `known`, up to those that prolong `last`, into a state of their own."""
        part = self._state(dict(self.next[known]), self.length[last] + 1)
        self.link[part], self.link[known] = self.link[known], part
        while last >= 0 and self.next[last].get(c) == known:
            self.next[last][c] = part
            last = self.link[last]
        return part

    def _walk(self, ids: list[int]) -> int:
        s = 0
        for c in ids:
            s = self.next[s][c]
        return s

    def matches(self, ids: list[int], window: int) -> Iterator[tuple[int, int]]:
        """For an item: the class of each of its windows, with its end."""
        for i in range(window, len(ids) + 1):
            s = self._walk(ids[i - window : i])
            yield s, i

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Streams the words; spans (start, end) of the longest window ending at each hit, and the items that occur."""
        spans, items = [], set()
        if not self.shortest:
            return spans, items
        nexts, link, length = self.next, self.link, self.length
        shortest, window = self.shortest, self.window
        root = nexts[0]
        state = run = 0
        here = root
        for i, c in enumerate(map(self.vocabulary.get, words)):
            to = here.get(c)
            if to is None:
                while state:
                    state = link[state]
                    to = nexts[state].get(c)
                    if to is not None:
                        run = length[state]
                        break
                else:
                    to = root.get(c)
                    run = 0
                    if to is None:
                        state, here = 0, root
                        continue
            state = to
            here = nexts[to]
            run += 1
            if run < shortest:
                continue
            widest = 0
            if run >= window:
                widest = window
                items |= self.window_items[state]
            up = self.short_up[state]
            while up > 0:
                for k, item in self.short_items[up]:
                    if k <= run:
                        items.add(item)
                        widest = max(widest, k)
                up = self.short_up[link[up]]
            if widest:
                spans.append((i + 1 - widest, i + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    max_span_words: int | None = None,
    coverage: float = 0.05,
    chunk_bytes: int = 1 << 20,
    clean: bool = False,
) -> DataFrame:
    """Carries the columns `keep` and adds, for each row of docs, in one pass and without a shuffle:

    n_words, n_hit (words inside an occurrence of a window), items (ids of the items that occur, as strings,
    sorted), spans (disjoint hit spans in words), contaminated (n_hit > 0 and n_hit >= coverage * n_words,
    or a span of more than max_span_words words where that is given) and, with clean=True, cleaned (the text
    without its hit spans).

    An automaton is of about chunk_bytes of items (or of one longer item) and goes to the executors by broadcast. More items
    are dealt over more automata by a hash. The documents are then written once, with a number each; they are read once for each automaton,
    which leaves a table of the hits alone and is gone before the next is made, so memory is bounded whatever the benchmark; at the end
    the hits join the documents. Null or wordless texts have no words and no hits;
    an item without id is found but not listed; repeated items count once; repeated documents are judged each; no items: nothing
    is hit.
    """
    context = docs.sparkSession.sparkContext
    rows = items.select(F.col(item_id_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    rows = rows.filter("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(-(-size // chunk_bytes), 1)
    names = apart(keep, {"__text", "__row", "__spans", "__items", "n_words", "n_hit", "items", "spans", "contaminated", *(["cleaned"] if clean else [])})
    out = docs.select(F.col(text_col).alias("__text"), *(F.col(k).alias(v) for k, v in names.items()))

    def judged(got: dict[str, list], t: bytes | None, words: list[bytes], spans: list[tuple[int, int]], found: set) -> None:
        spans = merged(spans)
        hit = sum(e - s for s, e in spans)
        long = max_span_words is not None and any(e - s > max_span_words for s, e in spans)
        got["n_words"].append(len(words))
        got["n_hit"].append(hit)
        got["items"].append(sorted(x for x in found if x is not None))
        got["spans"].append([{"start": s, "end": e} for s, e in spans])
        got["contaminated"].append(hit > 0 and (long or hit >= round(coverage * len(words), 9)))
        if clean:
            got["cleaned"].append(None if t is None else without(t.decode(), spans))

    final = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", SPANS),
        T.StructField("contaminated", T.BooleanType()),
        *([T.StructField("cleaned", T.StringType())] if clean else []),
    ]

    def automaton_of(chunk: DataFrame):
        return context.broadcast(Automaton([(r.i, words_of(r.t.encode())) for r in chunk.collect()], window))

    if n == 1:
        shared = automaton_of(rows)

        def setup():
            automaton = shared.value

            def work(texts: list) -> dict[str, list]:
                got: dict[str, list] = {f.name: [] for f in final}
                for t in texts:
                    words = words_of(t)
                    judged(got, t, words, *automaton.scan(words))
                return got

            return work

        return map_column(out, "__text", list(names.values()), final, setup, binary=True)

    chunks = written(rows.withColumn("chunk", F.pmod(F.xxhash64("t", "i"), F.lit(n))))
    numbered = written(out.withColumn("__row", F.monotonically_increasing_id()))
    hits, tables = None, []
    for k in range(n):
        shared = automaton_of(chunks.filter(F.col("chunk") == k))

        def setup(shared=shared):
            automaton = shared.value

            def work(texts: list) -> dict[str, list]:
                got: dict[str, list] = {"__spans": [], "__items": []}
                for t in texts:
                    spans, found = automaton.scan(words_of(t))
                    got["__spans"].append([{"start": s, "end": e} for s, e in merged(spans)])
                    got["__items"].append([x for x in found if x is not None])
                return got

            return work

        between = [T.StructField("__spans", SPANS), T.StructField("__items", T.ArrayType(T.StringType()))]
        tables.append(written(map_column(numbered, "__text", ["__row"], between, setup, binary=True).filter(F.size("__spans") > 0)))
        hits = tables[-1] if hits is None else hits.union(tables[-1])
        shared.destroy()
    hits = written(hits.groupBy("__row").agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.flatten(F.collect_list("__items")).alias("__items")))
    for table in (chunks, *tables):
        forget(table)

    def finish():
        def work(texts: list, spans: list, found: list) -> dict[str, list]:
            got: dict[str, list] = {f.name: [] for f in final}
            for t, own, ids in zip(texts, spans, found, strict=True):
                judged(got, t, words_of(t), [(s["start"], s["end"]) for s in own or ()], set(ids or ()))
            return got

        return work

    return map_column(numbered.join(hits, "__row", "left"), ["__text", "__spans", "__items"], list(names.values()), final, finish, binary=True)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; spans count words."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*parts, text[at:]])
