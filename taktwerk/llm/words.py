"""Words of many texts at once, as arrays: what the operators that count words over a corpus share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text whose words a task holds as arrays at a time (some 20 bytes of arrays a byte); a longer text alone.
PART_BYTES = 6 << 20
WORD, GAP, BREAK = 0, 1, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: part of a word, a gap between words, or a break that no run of words spans."""
    out = np.full(256, WORD, np.uint8)
    out[list(gaps)] = GAP
    out[list(breaks)] = BREAK
    return out


class Words:
    """The words of some texts, A-Z folded, in order.

    terms holds the distinct words as bytes, ids the number of each word in it, text the number of the text it is from, piece a
    number that differs wherever a break or a text's end lies between two words.
    """

    def __init__(self, texts: list[bytes | None], kind: np.ndarray):
        texts = [t or b"" for t in texts]
        data = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
        of = kind[data]
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = of == WORD
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        solid[1 + ends_of_texts[:-1]] = False
        starts = np.flatnonzero(solid[1:] & ~solid[:-1])
        ends = np.flatnonzero(solid[:-1] & ~solid[1:])
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        letters = data[solid[1:-1]]
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = found.dictionary_encode()
        self.terms = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.text = np.searchsorted(ends_of_texts, starts)
        self.piece = self.text + np.searchsorted(np.flatnonzero(of == BREAK), starts)


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, gathered or cut to about `limit` bytes of a binary column; a longer value alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(lengths[at:], dtype=np.int64)
            to = at + max(int(np.searchsorted(ends, limit - size, side="right")), 0 if held else 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - at - 1])
            if to < batch.num_rows or size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            at = to
    if held:
        yield pa.concat_batches(held)
