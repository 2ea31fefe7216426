"""64-bit keys of words, lines and word windows, computed on whole Arrow buffers.

A key is a polynomial over a byte table, mixed. It depends on the bytes alone, so every
task and every run gives the same keys. Words are runs of bytes other than blank and
tab to carriage return (bytes 9 to 13), which never occur inside a UTF-8 character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = np.uint64(0x9FB21C651E98DF25)
BLANKS = (9, 10, 11, 12, 13, 32)


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finalizer of the public splitmix generator)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD_VALUES = _BYTE_VALUES.copy()
_WORD_VALUES[list(BLANKS)] = 0
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS)] = True
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(size: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, for positions below ``size``."""
    global _powers, _inverses
    if len(_powers) < size:
        size = 1 << (size - 1).bit_length()
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        _inverses = np.multiply.accumulate(steps)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offset of each (one more than texts); nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts in order: keys, byte starts, and each text's first word (one more)."""

    keys: np.ndarray
    starts: np.ndarray
    firsts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Keys of the words; ``lower`` folds A-Z only."""
    data, offsets = utf8(pc.ascii_lower(texts) if lower else texts)
    if len(data) == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    blank = _IS_BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = ~blank[inner]
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return Words(np.zeros(0, np.uint64), starts, firsts)
    _grow(len(data))
    sums = np.add.reduceat(_WORD_VALUES[data] * _powers[: len(data)], starts)
    return Words(mix(sums * _inverses[starts]), starts, firsts)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of byte ranges, every byte counting; equal ranges have equal keys."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverses[starts])


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One key for several keys in order."""
    total = parts[0]
    for part in parts[1:]:
        total = mix(total * _STEP + part)
    return total


def windows(keys: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of ``size`` consecutive keys."""
    count = len(keys) - size + 1
    return chain([keys[k: k + count] for k in range(size)]) if count > 0 else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending; a text of fewer words makes one shingle."""
    found = words(texts)
    runs = windows(found.keys, size)
    sets = []
    for first, end in zip(found.firsts[:-1], found.firsts[1:]):
        if end - first >= size:
            sets.append(np.unique(runs[first: end - size + 1]))
        elif end > first:
            sets.append(chain([found.keys[k: k + 1] for k in range(first, end)]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
