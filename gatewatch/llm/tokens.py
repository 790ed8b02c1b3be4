"""Words of many texts at once, on their UTF-8 bytes: all separators here are ASCII, so bytes decide as characters would."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte: 0 in a word, 1 between words, 2 between pieces."""
    out = np.zeros(256, np.uint8)
    out[list(spaces)] = 1
    out[list(breaks)] = 2
    return out


@dataclass
class Words:
    """Every word of some texts in order: the index of its text, the number of its piece, and its code among the distinct `words`,
    which are in lower case (A-Z only)."""

    text: np.ndarray
    piece: np.ndarray
    code: np.ndarray
    words: pa.BinaryArray


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    """The words of the texts; a null one has none."""
    # one byte between texts, so that no word goes on into the next
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    lengths = np.array([len(t) for t in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    what = kind[data]
    inside = what == 0
    breaks = np.flatnonzero(what == 2)
    starts_of = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts_of[1:])
    inside[starts_of[1:] - 1] = False
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    letters = LOWER[data[inside]]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    text = np.searchsorted(starts_of, start, "right") - 1
    piece = np.searchsorted(breaks, start) + text
    return Words(text, piece, found.indices.to_numpy().astype(np.int64), found.dictionary)


def parts(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """Ranges of texts of about `size` bytes each; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)) + 1)
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        out.append((at, to))
        at = to
    return out
