"""Words of many texts at once: bounds, 64-bit hashes and hashes of windows, without a Python object a word.

Words are what stands between the ASCII white space 09 to 0D and 20. A word's hash is a polynomial in its
bytes modulo 2^64, got from prefix sums over a block of bytes and finished by a mixing step.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once: small enough for a processor's cache.
BLOCK_BYTES = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _ODD
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` hashes, in order of their starts: by doubling, then two overlapping halves."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        both = lambda x, k: mix(x[: len(x) - k] * np.uint64(3) + x[k:] + np.uint64(size))
        out, k = mix(hashes + np.uint64(size)), 1
        while 2 * k <= size:
            out, k = both(out, k), 2 * k
        return both(out, size - k) if k < size else out


@lru_cache(4)
def _powers(length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    base = _BASE[seed]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(length, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """The words of an Arrow column of texts (null: none).

    raw, offsets: all bytes and where each text begins; starts, ends: bounds of all words; first[i]: number of the first
    word of text i (with one entry more at the end); owner: the text of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        _, cuts, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        cuts = np.frombuffer(cuts, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
        self.offsets = cuts - cuts[0]
        self.raw = LOWER[raw] if lower else raw
        inside = ~SPACE[raw]
        n = len(raw)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        heads = self.offsets[:-1][self.offsets[:-1] < n]
        begin[heads] = inside[heads]
        tails = self.offsets[1:][self.offsets[1:] > 0] - 1
        end[tails] = inside[tails]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.total = len(self.starts)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hashes:
            out = np.zeros(self.total, np.uint64)
            cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.raw), BLOCK_BYTES)), self.total))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                s, e = self.starts[i:j], self.ends[i:j]
                base = int(s[0])
                bytes_ = self.raw[base : int(e[-1])]
                power, inverse = _powers(1 << int(len(bytes_)).bit_length(), seed)
                sums = np.zeros(len(bytes_) + 1, np.uint64)
                np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * power[: len(bytes_)], out=sums[1:])
                out[i:j] = (sums[e - base] - sums[s - base]) * inverse[s - base]
            self._hashes[seed] = mix(out)
        return self._hashes[seed]

    def windows(self, size: int, checked: bool = False) -> tuple[np.ndarray, ...]:
        """(text, place in its words, hash[, second hash]) of every `size` words of one text."""
        h = combined(self.hashes(), size)
        good = np.flatnonzero(self.owner[: len(h)] == self.owner[size - 1 :]) if len(h) else np.zeros(0, np.int64)
        d = self.owner[good]
        out = (d, (good - self.first[d]).astype(np.int32), h[good])
        return (*out, combined(self.hashes(1), size)[good]) if checked else out

    def sums(self, mark: np.ndarray) -> np.ndarray:
        """How many words of each text are marked."""
        return np.diff(np.concatenate([[0], np.cumsum(mark)])[self.first])

    def joined(self, stay: np.ndarray) -> pa.Array:
        """Of each text the words that stay, joined by one space."""
        kept = np.flatnonzero(stay)
        owner = self.owner[kept]
        more = np.append(owner[1:] == owner[:-1], False)[: len(kept)]
        cover = np.zeros(len(self.raw) + 2, np.int8)
        cover[self.starts[kept]] += 1  # no place comes twice
        cover[self.ends[kept] + more] -= 1
        text = np.where(SPACE[self.raw], np.uint8(32), self.raw)[np.cumsum(cover[:-2], dtype=np.int8) > 0]
        sizes = np.bincount(owner, self.ends[kept] - self.starts[kept] + more, len(self.first) - 1).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        large = cuts[-1] >= 1 << 31
        kind = pa.large_string() if large else pa.string()
        made = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(cuts.astype(np.int64 if large else np.int32).tobytes()), pa.py_buffer(text.tobytes())])
        return made
