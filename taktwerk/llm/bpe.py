"""BPE encoding and decoding; merges are chosen by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import partial

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taktwerk.llm.common import map_column

NONE = 1 << 62
# The white space of Unicode, which the normaliser turns into one space.
SPACE = "\t-\r\x20\x85\xa0  -     　"
# How the vocabulary parts a text before the merges.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
# Letters and digits of the regex module (first and last code point) that the tokenizers library doesn't know yet.
LATER = """
0558 0558 058B 058C 088F 088F 0C5C 0C5C 0CDC 0CDC 208F 208F 209D 209F A7CE A7CF A7D2 A7D2 A7D4 A7D4 A7DD A7DD A7E2 A7E2 A7F1 A7F1
AB6C AB6D 107BB 107BF 10940 10959 10EC5 10EC7 10ED9 10EEE 11B0A 11B0A 11DB0 11DDB 11DE0 11DE9 11DF1 11DF1 1246F 1246F 12475 1247F
12550 12686 16EA0 16EB8 16EBB 16ED3 16FF2 16FF6 187F8 187FF 18CD6 18CDA 18D09 18D20 18D80 18DF2 18E00 19191 191A0 191D2 1B123 1B128
1B168 1B168 1D6A6 1D6A6 1DF1F 1DF24 1DF2B 1DF81 1DF90 1DF96 1DFCD 1DFFF 1E6C0 1E6DE 1E6E0 1E6E2 1E6E4 1E6E5 1E6E7 1E6ED 1E6F0 1E6F4
1E6FE 1E6FF 2B73A 2B73F 2B81E 2B81E 2CEA2 2CEAD 323B0 33479 3D000 3FC3F
"""
# Capitals that the library lowers and Python doesn't yet.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def ranges(bounds: str) -> str:
    """The inside of a character class, from first and last code points in hexadecimal."""
    points = [rf"\U{int(x, 16):08x}" for x in bounds.split()]
    return "".join(f"{a}-{z}" for a, z in zip(points[::2], points[1::2], strict=True))


class PairTree:
    """A segment tree, 16 children a node: leaves hold rank and place of the pairs, each node the least of its children.

    Wide nodes make an update a few minima of 16 numbers each; a piece of up to 16 pairs has a root and leaves only.
    """

    __slots__ = ("levels", "put", "top")

    def __init__(self, keys: list[int]):
        level = keys
        self.levels = [level]
        while len(level) > 16:
            level = [min(level[i : i + 16]) for i in range(0, len(level), 16)]
            self.levels.append(level)
        self.top = level  # the children of the root
        self.put = self.update if len(self.levels) > 1 else keys.__setitem__

    def update(self, place: int, key: int) -> None:
        level = self.levels[0]
        level[place] = key
        for above in self.levels[1:]:
            place >>= 4
            low = min(level[place << 4 : place + 1 << 4])
            if above[place] == low:
                return
            above[place] = low
            level = above


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary read from a tokenizer file, with a bounded cache of parts between spaces."""

    def __init__(self, path: str, cache_entries: int = 200_000):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.pieces = regex.compile(PIECES)
        later = ranges(LATER)
        known = PIECES.replace(r"[\p{L}]+", rf"(?:(?![{later}])\p{{L}})+").replace(r"[\p{N}]|", rf"(?![{later}])\p{{N}}|")
        self.known = regex.compile(known.replace(rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"(?:[{later}]|[^{SPACE}\p{{L}}\p{{N}}])+"))
        self.later = regex.compile(f"[{later}]")
        self.capitals = regex.compile("[" + "".join(map(chr, CAPITALS)) + "]")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")  # white space to str.split, but not to the vocabulary
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.young: dict[str, tuple] = {}  # of parts between spaces and the pieces inside them: those seen lately,
        self.old: dict[str, tuple] = {}  # and those before
        self.cache_entries = cache_entries

    def _keep(self, key: str, value: tuple) -> tuple:
        """Puts an entry into the younger cache, which replaces the older one when it is full."""
        if len(key) <= 64:
            if len(self.young) >= self.cache_entries:
                self.old.clear()
                self.old.update(self.young)  # as the callers hold on to the dicts themselves
                self.young.clear()
            self.young[key] = value
        return value

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece: always the leftmost pair of the lowest rank is merged, until none can be."""
        letters = [self.letters[b] for b in piece.encode()]
        if not letters:
            return []
        letters[-1] += self.end
        ids = [self.vocab[x] for x in letters if x in self.vocab]
        if len(ids) < 2:
            return ids
        n, rank, merged = len(ids), self.ranks.get, self.merged
        bits = n.bit_length()
        place = (1 << bits) - 1
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        keys = [NONE if (r := rank(p)) is None else r << bits | i for i, p in enumerate(zip(ids, ids[1:], strict=False))]
        tree = PairTree(keys)
        put, top = tree.put, tree.top
        while (low := min(top)) != NONE:
            i = low & place
            gone = after[i]
            ids[i] = new = merged[low >> bits]
            ids[gone] = -1
            after[i] = right = after[gone]
            if right >= 0:
                before[right] = i
                put(gone, NONE)
                r = rank((new, ids[right]))
                put(i, NONE if r is None else r << bits | i)
            else:
                put(i, NONE)
            left = before[i]
            if left >= 0:
                r = rank((ids[left], new))
                put(left, NONE if r is None else r << bits | left)
        return [x for x in ids if x >= 0]

    def _part(self, part: str) -> tuple[int, str, str]:
        """Of a part without white space: number of tokens, ids and tokens, each joined by spaces."""
        found = self.young.get(part)
        if found is not None:
            return found
        found = self.old.get(part)
        if found is None:
            pieces = (self.pieces if part.isascii() or not self.later.search(part) else self.known).findall(part)
            if len(pieces) > 1:
                found = joined([x for x in map(self._part, pieces) if x[0]])
            else:
                ids = self.merge(pieces[0]) if pieces else []
                found = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
        return self._keep(part, found)

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.translate(CAPITALS) if self.capitals.search(text) else text
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        parts = self.spaces.split(text) if self.odd.search(text) else text.split()
        cache = self.young.get
        return [cache(p) or self._part(p) for p in parts if p]

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by one space, and the decoded text (tokens joined by one space)."""
        rows: list[tuple[int, str, str]] = []
        for part in self.parts.split(text) if self.parts and "<|" in text else [text]:
            if part in self.special:
                rows.append((1, str(self.special[part]), part))
            else:
                rows += self._plain(part)
        return joined([r for r in rows if r[0]])

    def decode(self, ids: str) -> str:
        return " ".join([self.names[int(i)] for i in ids.split()])


def joined(rows: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum([r[0] for r in rows]), " ".join([r[1] for r in rows]), " ".join([r[2] for r in rows])


FIELDS = {
    "n_tokens": T.LongType(),
    "ids": T.StringType(),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def bpe_encode(
    docs: DataFrame,
    keep: list[str],
    path: str,
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    cache_entries: int = 200_000,
) -> DataFrame:
    """Carries `keep` and adds the chosen outputs, in one pass without a shuffle.

    outputs: n_tokens; ids (decimal, joined by one space); decoded (the vocabulary has no decoder, so tokens
    are joined by one space); ids_sha256 and decoded_sha256, their digests, made in the task so that the long
    strings needn't leave it. A null text counts as empty: 0 tokens, empty ids. Strings of special tokens
    become their ids. Every executor must find the vocabulary under `path`; a task reads it once, and its two caches
    hold cache_entries entries of at most 64 letters each, so its memory is bounded and ends with the task.
    """

    def setup():
        bpe = WordBpe(path, cache_entries)

        def work(texts: list) -> dict[str, list]:
            got: dict[str, list] = {name: [] for name in outputs}
            for t in texts:
                n, ids, decoded = bpe.encode(t or "")
                made = {
                    "n_tokens": lambda n=n: n,
                    "ids": lambda ids=ids: ids,
                    "decoded": lambda decoded=decoded: decoded,
                    "ids_sha256": partial(sha, ids),
                    "decoded_sha256": partial(sha, decoded),
                }
                for name in outputs:
                    got[name].append(made[name]())
            return got

        return work

    return map_column(docs, text_col, keep, [T.StructField(name, FIELDS[name]) for name in outputs], setup)
