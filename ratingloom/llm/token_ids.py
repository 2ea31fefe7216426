"""Token ids of whole texts by a public tokenizer file, with remembered pieces.

A byte-level BPE tokenizer never joins what stands before and after a blank that has
non-blank characters on both sides: the blank starts a new piece. Texts are cut there on whole
Arrow buffers, each distinct piece of a slice is looked up once, and pieces not known yet are
encoded by the tokenizer. What is remembered is bounded in bytes and held in two generations: a
full one becomes the old one, and pieces met again move over. Ids do not depend on it.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from ratingloom.llm.tables import remembered, trim
from ratingloom.llm.text_keys import utf8

#: Bytes of each generation of remembered pieces, as Python and numpy hold them.
MEMORY_BYTES = 48 << 20
#: Longer pieces are encoded where they stand and not remembered.
LONGEST_PIECE = 64
#: What a remembered piece costs besides its bytes and ids.
PIECE_COST = 150
#: Bytes of new pieces that are handed to the tokenizer as one text.
JOINED_BYTES = 6000
#: Text bytes to encode at a time: more find more repeated pieces, and need more memory.
SLICE_BYTES = 3 << 20
#: White space of the tokenizer's rule in one byte, and further such characters (fixed values).
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                          0x3000)]
_encoders: dict[str, "Encoder"] = {}
remembered.append(_encoders)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizer file of that name is."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _wide_blank(data: np.ndarray, places: np.ndarray, before: bool) -> np.ndarray:
    """Whether a white space character of several bytes ends before, or begins at, each place."""
    found = np.zeros(len(places), dtype=bool)
    for blank in _WIDE_BLANKS:
        first = places - len(blank) if before else places
        same = (first >= 0) & (first + len(blank) <= len(data))
        for k, byte in enumerate(blank):
            same &= data[np.clip(first + k, 0, len(data) - 1)] == byte
        found |= same
    return found


def cut_pieces(texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pieces of all texts and the number of pieces of each; a piece but a text's first begins with a blank."""
    data, offsets = utf8(texts)
    if len(data) == 0:
        return pa.array([], pa.large_binary()), np.zeros(len(offsets) - 1, np.int64)
    blank = _BLANK[data]
    begins = data == 32
    begins[1:] &= ~blank[:-1]
    begins[:-1] &= ~blank[1:]
    ends = offsets[1:][np.diff(offsets) > 0]
    begins[ends - 1] = False
    begins[0] = False
    wide = np.flatnonzero(begins)
    near = wide[(data[wide - 1] >= 0x80) | (data[wide + 1] >= 0xC2)]
    begins[near[_wide_blank(data, near, True) | _wide_blank(data, near + 1, False)]] = False
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return pieces, np.diff(np.searchsorted(starts, offsets))


def _buffers(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Offsets from 0, and the bytes."""
    if len(pieces) == 0:
        return np.zeros(1, np.int64), memoryview(b"")
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset: pieces.offset + len(pieces) + 1]
    return offsets - offsets[0], memoryview(pieces.buffers()[2] or b"")[offsets[0]: offsets[-1]]


def _joins(pieces: pa.LargeBinaryArray) -> np.ndarray:
    """Which pieces begin with a blank before another character and do not end with one."""
    offsets, data = _buffers(pieces)
    sizes = np.diff(offsets)
    good = np.zeros(len(pieces), dtype=bool)
    some = np.flatnonzero(sizes > 1)
    if len(some):
        data = np.frombuffer(data, np.uint8)
        firsts, ends = offsets[:-1][some], offsets[1:][some]
        fine = (data[firsts] == 32) & ~_BLANK[data[firsts + 1]] & ~_BLANK[data[ends - 1]]
        wide = np.flatnonzero(fine & ((data[firsts + 1] >= 0xC2) | (data[ends - 1] >= 0x80)))
        fine[wide[_wide_blank(data, firsts[wide] + 1, False) | _wide_blank(data, ends[wide], True)]] = False
        good[some] = fine
    return good


class _Generation:
    """Remembered pieces: where the ids of each begin in ``pool``, and how many there are."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.bytes = 0

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of the pieces, -1 where unknown."""
        return np.array(list(map(self.slots.get, pieces, repeat(-1))), np.int64)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[slots]
        return self.pool[spread(self.begins[slots], lengths)], lengths

    def add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        known = len(self.lengths)
        self.slots.update(zip(pieces, range(known, known + len(pieces))))
        self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(lengths) - lengths])
        self.pool = np.concatenate([self.pool, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.bytes += PIECE_COST * len(pieces) + sum(map(len, pieces)) + 4 * len(ids)


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs given by where they begin and how long they are."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes lists of texts to one array of ids and the offset of each text."""

    def __init__(self, path: str):
        # Spark runs a worker a core: threads inside one would only compete.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # In a byte-level vocabulary every character of an entry stands for one byte.
        self.sizes = np.zeros(self.vocabulary, np.int64)
        for entry, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.sizes[number] = len(entry)
        self.young, self.old = _Generation(), _Generation()

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encode_pieces(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has.

        Pieces that begin with a blank and end without one may follow each other in one text; the bytes
        of the ids then tell where a piece ends.
        """
        joins = _joins(pieces)
        together, alone = pieces.filter(pa.array(joins)), pieces.filter(pa.array(~joins))
        offsets, data = _buffers(together)
        ends = offsets[1:]
        # Texts of about JOINED_BYTES, cut between pieces.
        firsts = np.flatnonzero(np.diff((ends - 1) // JOINED_BYTES, prepend=-1))
        bounds = offsets[np.append(firsts, len(together))].tolist()
        texts = alone.cast(pa.large_string()).to_pylist()
        texts += [str(data[a:b], "utf-8") for a, b in zip(bounds, bounds[1:])]
        encoded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.zeros(len(pieces), np.int64)
        lengths[~joins] = [len(ids) for ids in encoded[: len(alone)]]
        joined = np.concatenate([np.zeros(0, np.uint32), *encoded[len(alone):]])
        last = np.searchsorted(np.cumsum(self.sizes[joined]), ends) + 1
        lengths[joins] = np.diff(last, prepend=0)
        ids = np.zeros(int(lengths.sum()), np.uint32)
        of_joined = np.repeat(joins, lengths)
        ids[~of_joined] = np.concatenate([np.zeros(0, np.uint32), *encoded[: len(alone)]])
        ids[of_joined] = joined
        return ids, lengths

    def _known(self, distinct: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct pieces, learning those that are new."""
        if self.young.bytes > MEMORY_BYTES:
            self.old, self.young = self.young, _Generation()
        pieces = distinct.to_pylist()
        slots = self.young.find(pieces)
        found = slots >= 0
        parts, places = [self.young.ids(slots[found])], [np.flatnonzero(found)]
        missing = np.flatnonzero(~found)
        if len(missing):
            again = self.old.find([pieces[k] for k in missing.tolist()])
            moved, fresh = missing[again >= 0], missing[again < 0]
            for chosen, (ids, lengths) in ((moved, self.old.ids(again[again >= 0])),
                                           (fresh, self._encode_pieces(distinct.take(pa.array(fresh))))):
                parts.append((ids, lengths))
                places.append(chosen)
                names = [pieces[k] for k in chosen.tolist()]
                short = np.fromiter(map(len, names), np.int64, len(names)) <= LONGEST_PIECE
                kept = [name for name, keep in zip(names, short.tolist()) if keep]
                self.young.add(kept, ids[np.repeat(short, lengths)], lengths[short])
        place = np.concatenate(places)
        pool = np.concatenate([ids for ids, _ in parts])
        counts = np.concatenate([lengths for _, lengths in parts])
        lengths = np.zeros(len(pieces), np.int64)
        lengths[place] = counts
        begins = np.zeros(len(pieces), np.int64)
        begins[place] = np.cumsum(counts) - counts
        return pool[spread(begins, lengths)], lengths

    def rest(self) -> None:
        """At the end of a task: keep the pieces met last, free the rest."""
        self.old = _Generation()
        trim(forget=False)

    def encode(self, texts: list[str] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end`` if given, and where each text begins (one more)."""
        pieces, counts = cut_pieces(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        coded = pieces.dictionary_encode()
        places = coded.indices.to_numpy(zero_copy_only=False)
        pool, sizes = self._known(coded.dictionary)
        lengths = sizes[places]
        ids = pool[spread((np.cumsum(sizes) - sizes)[places], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        firsts = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        if end is not None:
            ids = np.insert(ids, firsts[1:], np.uint32(end))
            firsts = firsts + np.arange(len(firsts))
        return ids, firsts


def encoder(path: str) -> Encoder:
    """The encoder of a file, one in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
