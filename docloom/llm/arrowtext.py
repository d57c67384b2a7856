"""Words of Arrow text columns as numpy arrays: spans and 64-bit fingerprints.

Everything works on the UTF-8 bytes of a whole record batch at once, in blocks
of bounded size, so a document costs no Python call per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20

SPACE = np.ones(256, np.uint8)  # class 0: [\x20\x09-\x0D], class 1: the rest
SPACE[[9, 10, 11, 12, 13, 32]] = 0

WORD_OR_SIGN = SPACE.copy()  # class 2: ASCII that is neither letter, digit nor space
WORD_OR_SIGN[[b for b in range(128) if SPACE[b] and not chr(b).isalnum()]] = 2


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str, lower: bool = False) -> pa.Array:
    """A text column without nulls (null: empty); lower: A-Z only."""
    a = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    return pc.ascii_lower(a) if lower else a


def parts(texts: pa.Array, most: int = 2 << 20):
    """(first row, row past the last) of runs of rows with at most `most` bytes, or one row."""
    size = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))))
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row begins (one more entry than rows)."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of consecutive rows: maximal runs of bytes of one class other than 0.

    start, end: byte spans; first: index of the first word of each row, with one
    more entry at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACE):
        self.data, self.offsets, self.classes = data, offsets, classes
        kind = classes[data]
        n = len(data)
        breaks = np.zeros(n + 1, bool)
        if n:
            breaks[1:n] = kind[1:] != kind[:-1]
            breaks[offsets] = True
            breaks[0] = breaks[n] = True
        begin = np.flatnonzero(breaks[:n])
        stop = np.append(begin[1:], n)
        used = kind[begin] != 0 if n else np.zeros(0, bool)
        self.start, self.end = begin[used], stop[used][: int(used.sum())]
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word's bytes."""
        out = np.empty(len(self), np.uint64)
        byte = np.where(self.classes == 0, np.uint64(0), _BYTE)
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + _BLOCK)))
            lo, hi = self.start[at], self.end[to - 1]
            begin = self.start[at:to] - lo
            span = np.diff(np.append(begin, hi - lo))
            place = np.arange(hi - lo) - np.repeat(begin, span)
            place = np.minimum(place, int((self.end[at:to] - self.start[at:to]).max()))
            power = np.full(int(place.max()) + 1, _BASE)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            sums = np.add.reduceat(byte[self.data[lo:hi]] * power[place], begin)
            out[at:to] = mix(sums + (self.end[at:to] - self.start[at:to]).astype(np.uint64))
            at = to
        return out

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of each n consecutive words; entry i begins at word i. Rows are not looked at."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    acc = mix(hashes[:m])
    for k in range(1, n):
        acc = mix(acc * _BASE + hashes[k : k + m])
    return acc
