"""Secret scans: fixed patterns, and formats learned from labelled credentials by grammar inference."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taktwerk.llm.common import chunks, forget, map_column, written

# The base patterns and the least length of what they must find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEARNED = "grammar"
# The letters of what the grammars score; up to two `=` may follow a run of them.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-="
EDGES = ".-"  # signs of the sentence, at the ends of a run no part of it
CODE = np.full(0x110000, -1, np.int8)
CODE[[ord(c) for c in LETTERS]] = range(len(LETTERS))
EQUALS, BORDER = LETTERS.index("="), len(LETTERS)
# log2 probability of a letter once no sample went that way: so low that a run of another format is none of this one.
LOST = -10.0
# Runs longer than this are scored one by one instead of side by side.
SIDE_BY_SIDE = 512


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed; leftmost and non-overlapping per kind."""
    small = text.lower()
    found = []
    if any(word in small for word in ASSIGN_WORDS):  # no assign match is without one of them
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def symbol(letter: str) -> str:
    """The class of a letter: digit, a-f, other small, A-F, other capital, or the mark itself."""
    if letter.isdigit():
        return "0"
    if letter.islower():
        return "f" if letter <= "f" else "z"
    if letter.isupper():
        return "F" if letter <= "F" else "Z"
    return letter


CLASSES = sorted(set(map(symbol, LETTERS)))
CLASS = np.array([CLASSES.index(symbol(c)) for c in LETTERS])
SIZES = np.bincount(CLASS)


class State:
    """A state: its samples, those that end, the counts of each next class and letter, and how many letters are still to come."""

    __slots__ = ("seen", "ends", "next", "letters", "left")

    def __init__(self):
        self.seen = self.ends = 0
        self.next: dict[int, State] = {}
        self.letters: Counter = Counter()
        self.left: Counter = Counter()

    def add(self, other: State) -> None:
        self.seen += other.seen
        self.ends += other.ends
        self.letters.update(other.letters)
        self.left.update(other.left)


class Grammar:
    """A probabilistic automaton of one kind of credential, inferred from samples.

    Built as a prefix tree over letter classes with counts; states are then merged, nearest to the root first, each with the most
    alike of the states it is compatible with: the frequencies of ending and of each next class, and the distribution of how many
    letters are still to come, must agree by Hoeffding's and Kolmogorov's bounds (at risk alpha). The last keeps lengths and
    prefixes apart that random letters would hide. A transition's probability is its class's, times its letter's in that class
    as this state saw it; what no sample did keeps a little of it.
    """

    def __init__(self, samples: list[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        root = State()
        for sample in samples:
            state = root
            codes = [LETTERS.index(c) for c in sample]
            for i, c in enumerate(codes):
                state.seen += 1
                state.letters[c] += 1
                state.left[len(codes) - i] += 1
                state = state.next.setdefault(int(CLASS[c]), State())
            state.seen += 1
            state.ends += 1
            state.left[0] += 1
        red, waiting = [root], deque((root, c) for c in sorted(root.next))
        while waiting:
            up, c = waiting.popleft()
            blue = up.next[c]
            if any(blue is r for r in red):
                continue
            known = [(d, i) for i, r in enumerate(red) if (d := self.distance(r, blue)) is not None]
            if known:
                up.next[c] = red[min(known)[1]]
                waiting += self.fold(up.next[c], blue, red)
            else:
                red.append(blue)
                waiting += [(blue, x) for x in sorted(blue.next)]
        self.states = red
        self.shortest = min(map(len, samples), default=0)
        self.tables()

    def distance(self, a: State, b: State) -> float | None:
        """How much two states differ, None if by more than chance allows."""
        allowed = self.bound * (1 / math.sqrt(a.seen) + 1 / math.sqrt(b.seen))
        most = abs(a.ends / a.seen - b.ends / b.seen)
        of_class = [np.bincount(CLASS[list(x.letters)], list(x.letters.values()), len(CLASSES)) / x.seen if x.letters else np.zeros(len(CLASSES)) for x in (a, b)]
        most = max(most, float(np.abs(of_class[0] - of_class[1]).max()))
        gap = 0.0
        for k in sorted(a.left.keys() | b.left.keys()):
            gap += a.left[k] / a.seen - b.left[k] / b.seen
            most = max(most, abs(gap))
        return None if most > allowed else most

    def fold(self, into: State, tree: State, red: list[State]) -> list[tuple[State, int]]:
        """Adds a subtree, which no other state reaches, to a state and what it leads to; new ways are returned."""
        new, stack = [], [(into, tree)]
        while stack:
            a, b = stack.pop()
            a.add(b)
            for c, to in b.next.items():
                if c in a.next:
                    stack.append((a.next[c], to))
                else:
                    a.next[c] = to
                    if any(a is r for r in red):
                        new.append((a, c))
        return new

    def tables(self) -> None:
        """emit: log2 probability of each letter, and of the end, by state; to: the next state by class. The last state is that of lost ways."""
        n = len(self.states)
        at = {id(s): i for i, s in enumerate(self.states)}
        plain = 1 / (len(LETTERS) + 1)
        self.emit = np.full((n + 1, len(LETTERS) + 1), LOST, np.float32)
        self.to = np.full((n + 1, len(CLASSES)), n, np.int16)
        for i, s in enumerate(self.states):
            counts = np.zeros(len(LETTERS))
            counts[list(s.letters)] = list(s.letters.values())
            of_class = np.bincount(CLASS, counts, len(CLASSES))
            share = (of_class + plain * SIZES) / (s.seen + 1)
            within = (counts + 0.5) / (of_class + 0.5 * SIZES)[CLASS]
            self.emit[i, :-1] = np.log2(share[CLASS] * within)
            self.emit[i, -1] = math.log2((s.ends + plain) / (s.seen + 1))
            for c, to in s.next.items():
                self.to[i, c] = at[id(to)]

    def score(self, run: str) -> float:
        """The log2 probability of a run and its end."""
        s, total = 0, 0.0
        emit, to = self.lists()
        for c in map(LETTERS.index, run):
            total += emit[s][c]
            s = to[s][CLASS[c]]
        return total + emit[s][-1]

    def lists(self) -> tuple[list, list]:
        return self.emit.tolist(), self.to.tolist()

    def scores(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The same for many runs of codes, side by side; they must come longest first."""
        state, total = np.zeros(len(start), np.int16), np.zeros(len(start))
        active = len(start)
        for i in range(int(length[0]) if len(start) else 0):
            active = int(np.searchsorted(-length, -i, "left"))  # runs of more than i letters
            c = codes[start[:active] + i]
            total[:active] += self.emit[state[:active], c]
            state[:active] = self.to[state[:active], CLASS[c]]
        return total + self.emit[state, -1]


def runs_in(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the candidates: runs of letters, with up to two `=` behind them, without signs of the sentence at their ends."""
    inside = np.append(np.append(False, (codes >= 0) & (codes != EQUALS)), False)
    steps = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)
    padded = np.append(codes, [-1, -1])
    edges = [LETTERS.index(c) for c in EDGES]
    plain = padded[end] != EQUALS
    for _ in range(2):
        end = end + (padded[end] == EQUALS)
    while len(start):  # a sign at an end goes; a run of signs alone vanishes
        drop = (start < end) & np.isin(padded[start], edges)
        cut = plain & (start < end) & ~drop & np.isin(padded[end - 1], edges)
        if not (drop.any() or cut.any()):
            break
        start, end = start + drop, end - cut
    return start[start < end], end[start < end]


class FormatModel:
    """Grammars by kind against the letter pairs of ordinary runs; a run is a secret if a grammar is the likelier by more than `margin`
    bits: odds of a million to one for what is as rare as one run in a million."""

    def __init__(self, labelled: dict[str, list[str]], pairs: dict[str, int], margin: float = 20.0, least: int = 8):
        """pairs: how often two letters follow each other in ordinary runs; a blank stands for where a run begins and ends."""
        self.grammars = {k: Grammar(sorted(v)) for k, v in sorted(labelled.items()) if len(v) >= least}
        counts = np.zeros((BORDER + 1, BORDER + 1))
        signs = LETTERS + " "
        for pair, n in pairs.items():
            counts[signs.index(pair[0]), signs.index(pair[1])] += n
        alone = counts.sum(axis=0) + 0.1
        mixed_in = counts + 20 * alone / alone.sum()  # letters that are rare in front tell little of what follows
        self.pairs = np.log2(mixed_in / mixed_in.sum(axis=1, keepdims=True)).astype(np.float32)
        self.margin = margin
        self.shortest = min((g.shortest for g in self.grammars.values()), default=0)

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of codes of letters: start, end and format likelihood (bits over an ordinary run) of every run as long as a credential."""
        start, end = runs_in(codes)
        length = end - start
        some = np.flatnonzero(length >= max(self.shortest, 1)) if self.grammars else np.zeros(0, int)
        some = some[np.argsort(-length[some], kind="stable")]
        start, end, length = start[some], end[some], length[some]
        best = np.full(len(some), -np.inf)
        n_long = int(np.searchsorted(-length, -SIDE_BY_SIDE, "left"))
        for g in self.grammars.values():
            emit, to = g.lists() if n_long else ([], [])
            for i in range(n_long):
                s, total = 0, 0.0
                for c in codes[start[i] : end[i]].tolist():
                    total += emit[s][c]
                    s = to[s][CLASS[c]]
                best[i] = max(best[i], total + emit[s][-1])
            best[n_long:] = np.maximum(best[n_long:], g.scores(codes, start[n_long:], length[n_long:]))
        if not len(some):
            return start, end, best
        follow = np.append(0, np.cumsum(self.pairs[codes[:-1], codes[1:]], dtype=np.float64))
        plain = follow[end - 1] - follow[start] + self.pairs[BORDER, codes[start]] + self.pairs[codes[end - 1], BORDER]
        return start, end, best - plain

    def scan(self, texts: list[str]) -> list[tuple[list[tuple[int, int]], float | None]]:
        """Of each text: the runs that a grammar finds, in order, and the best likelihood of any candidate (None without one)."""
        out: list[tuple[list[tuple[int, int]], float | None]] = []
        for _, some in chunks(texts):
            points = np.frombuffer("\n".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
            bounds = np.cumsum([0, *(len(t) + 1 for t in some)])
            start, end, bits = self.candidates(CODE[points].astype(np.int64))
            own = np.searchsorted(bounds, start, "right") - 1
            best = np.full(len(some), -np.inf)
            np.maximum.at(best, own, bits)
            found: list[list[tuple[int, int]]] = [[] for _ in some]
            for i in np.flatnonzero(bits > self.margin).tolist():
                found[own[i]].append((int(start[i] - bounds[own[i]]), int(end[i] - bounds[own[i]])))
            out += [(sorted(f), float(b) if b > -np.inf else None) for f, b in zip(found, best.tolist(), strict=True)]
        return out


def labelled_rows(docs: DataFrame, text_col: str, longest: int) -> DataFrame:
    """(kind, value, n) in all documents: the credentials that base patterns label, up to `longest` letters each,
    and (pair) how often two letters follow each other in all other runs."""
    rows = docs.select(F.col(text_col).cast("string").alias("t")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((BORDER + 1, BORDER + 1), np.int64)
        for batch in batches:
            values: Counter = Counter()
            for t in batch.column(0).to_pylist():
                base = base_spans(t)
                values.update((k, t[s:e]) for s, e, k in base if k != "assign" and e - s <= longest)
                values.update(("assign", m[2]) for m in ASSIGN.finditer(t) if 6 <= len(m[2]) <= longest)
                codes = CODE[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
                start, end = runs_in(codes)
                covered = np.zeros(len(t) + 1, np.int64)
                for s, e, _ in base:
                    covered[s] += 1
                    covered[e] -= 1
                touched = np.append(0, np.cumsum(np.cumsum(covered) > 0))
                free = touched[end] == touched[start]
                start, end = start[free], end[free]
                np.add.at(pairs, (BORDER, codes[start]), 1)
                np.add.at(pairs, (codes[end - 1], BORDER), 1)
                inside = np.zeros(len(t) + 1, np.int64)
                inside[start] += 1
                inside[end - 1] -= 1
                at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                np.add.at(pairs, (codes[at], codes[at + 1]), 1)
            yield table([(k, v, c) for (k, v), c in values.items()])
        signs = LETTERS + " "
        yield table([("pair", signs[a] + signs[b], int(pairs[a, b])) for a, b in zip(*np.nonzero(pairs), strict=True)])

    def table(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 3
        types = [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "value", "n"])

    return rows.mapInArrow(run, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", samples: int = 400, longest: int = 256, least: int = 8) -> FormatModel:
    """Learns the formats from what the base patterns label in all documents.

    The model of ordinary runs counts all others in them. Of each kind, `samples` of all different values of at most `longest` letters make
    the grammar, by the order of a hash: its prefix tree is built on the driver, so it must be bounded. A kind with fewer than `least` values gets no grammar;
    without grammars nothing is added.
    """
    rows = written(labelled_rows(docs, text_col, longest))
    labelled = {}
    for kind in KINDS:
        some = rows.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(samples)
        labelled[kind] = [r.value for r in some.collect()]
    pairs = {r.value: r.n for r in rows.filter("kind = 'pair'").collect()}  # at most the square of the letters
    forget(rows)
    return FormatModel(labelled, pairs, least=least)


SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def scan(docs: DataFrame, keep: list[str], model: FormatModel | None, text_col: str = "text") -> DataFrame:
    """Carries `keep` and adds, in one pass, base and spans, arrays of (kind, start, end) in code points, and best_bits.

    base: what the fixed patterns find, by start, then kind as listed; spans: those and what the grammars find, in the same order,
    kind `grammar` last. Every run as long as the shortest labelled credential is scored, inside base spans too: a grammar's span
    may be a base span's value, or go beyond it. best_bits: the greatest format likelihood of a text's candidates, in bits over
    an ordinary run; null without any. A null or empty text has no spans; repeated rows are scanned each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("base", SPAN), T.StructField("spans", SPAN), T.StructField("best_bits", T.DoubleType())]
    order = {k: i for i, k in enumerate((*KINDS, LEARNED))}

    def setup():
        def work(texts: list) -> dict[str, list]:
            texts = [t or "" for t in texts]
            bases = [base_spans(t) for t in texts]
            found = shared.value.scan(texts) if shared.value is not None else [([], None)] * len(texts)
            wholes = [sorted([*b, *((s, e, LEARNED) for s, e in f)], key=lambda x: (x[0], order[x[2]])) for b, (f, _) in zip(bases, found, strict=True)]
            listed = [[[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in some] for some in (bases, wholes)]
            return {"base": listed[0], "spans": listed[1], "best_bits": [bits for _, bits in found]}

        return work

    return map_column(docs, text_col, keep, fields, setup)


def redacted(text_col: str, spans_col: str, mark: str = "[secret]"):
    """An expression: the text with every span, or what touching spans cover together, replaced by the mark."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc, span):
        text = F.col(text_col)
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        apart = F.when(span["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(apart.alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    plain = F.size(spans_col) == 0
    return F.when(plain | F.col(text_col).isNull(), F.col(text_col)).otherwise(
        F.aggregate(F.col(spans_col), empty, add, finish)
    )
