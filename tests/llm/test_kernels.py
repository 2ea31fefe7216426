"""Kernels without Spark: keys, encoding, bit packing, sweeps, dictionaries."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from ratingloom.llm import line_dedup, packing, text_keys, token_ids, token_store
from ratingloom.llm.quality_model import FitBounds, QualityModel, train_dictionary

TEXT = st.text(alphabet=st.sampled_from("ab é€😀\n\t .!AB"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_and_shingles_equal_plain_ones(texts):
    array = pa.array(texts, pa.string())
    found = text_keys.words(array, lower=False)
    plain = [brute.words(t) for t in texts]
    assert found.counts.tolist() == [len(w) for w in plain]
    keys = {}
    for word, key in zip([w for ws in plain for w in ws], found.keys.tolist()):
        assert keys.setdefault(word, key) == key
    assert len(set(keys.values())) == len(keys)
    assert [len(s) for s in text_keys.shingle_sets(array, 5)] == [len(brute.shingles(t)) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_lines_equal_plain_ones(texts):
    found = line_dedup.lines_of(pa.array(texts, pa.string()))
    plain = [brute.lines(t) for t in texts]
    assert np.diff(found.firsts).tolist() == [len(p) for p in plain]
    assert found.words.tolist() == [len(line) for p in plain for line in p]


@pytest.fixture(scope="module")
def encoder():
    return token_ids.encoder(token_ids.tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é 　\x1c\n\t.,'s0_<|>"), max_size=40), max_size=5))
def test_remembered_pieces_encode_like_whole_texts(texts):
    encoder = token_ids.encoder(token_ids.tokenizer_path())
    texts = [*texts, "x <|endoftext|> y", " a  b", ""]
    ids, firsts = encoder.encode(texts, 0)
    for k, text in enumerate(texts):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert ids[firsts[k]: firsts[k + 1]].tolist() == want


def test_forgetting_pieces_changes_no_ids(encoder, monkeypatch):
    texts = [f"word{k} other{k} {k}" for k in range(50)]
    before, _ = encoder.encode(texts)
    monkeypatch.setattr(token_ids, "MEMORY_BYTES", 10)
    for k in range(3):
        after, _ = encoder.encode(texts)
        assert (before == after).all()


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 16, 17, 20, 32])
def test_bits_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 257, dtype=np.uint64).astype(np.uint32)
    packed = token_store.pack(ids, width)
    assert len(packed) == -(-257 * width // 8)
    assert (token_store.unpack(packed, width, 0, 257) == ids).all()
    for first, count in ((0, 0), (5, 1), (100, 57), (256, 1)):
        assert (token_store.unpack(packed, width, first, count) == ids[first: first + count]).all()
    if width < 32:
        with pytest.raises(ValueError):
            token_store.pack(np.array([1 << width], np.uint32), width)
    assert token_store.width_of(50257) == 16 and token_store.width_of(2) == 1 and token_store.width_of(1) == 1


def serial_best_fit(lengths, capacity):
    """Best-fit decreasing, one piece after the other."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [k for k, g in enumerate(gaps) if g >= length]
        if fitting:
            gaps[min(fitting, key=lambda k: gaps[k])] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_sweep_packs_as_serial_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 100])
    lengths = [min(capacity, int(rng.paretovariate(rng.choice([0.6, 1.2])))) for _ in range(rng.choice([1, 30, 500]))]
    if seed % 3 == 0:
        lengths += [rng.randint(1, capacity)] * 200  # a third of one length
    counts = np.bincount(lengths, minlength=capacity + 1)
    table = packing.sweep(counts, capacity)
    bins = {}
    for length in range(1, capacity + 1):
        for rank in range(counts[length]):
            rows = [k for k in np.flatnonzero(table["length"] == length) if table["low"][k] <= rank]
            k = rows[-1]
            past = rank - table["low"][k]
            where = int(table["bin"][k] + past // table["each"][k])
            bins.setdefault(where, []).append((int(table["offset"][k] + past % table["each"][k] * length), length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) == serial_best_fit(lengths, capacity)


def test_cut_keeps_all_tokens():
    for length in (1, 2047, 2048, 2049, 4096, 5000):
        pieces = packing.cut(length, 2048)
        assert sum(n for _, n in pieces) == length and all(n == 2048 for _, n in pieces[1:])
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]


def test_dictionary_from_few_texts_and_prior_without_labels():
    bounds = FitBounds()
    assert train_dictionary(["a b c"], bounds) == b"a b c"
    assert QualityModel(b"", b"", (), 0.25, bounds).scores(["", "x" * 9999]).tolist() == [0.25, 0.25]
    model = QualityModel(b"good text " * 9, b"bad text " * 9, (0.0, 5.0, 0.0), 0.5, bounds)
    assert ((0 <= model.scores(["", "good text good text", "é" * 5000])) & (model.scores(["", "a", "b"]) <= 1)).all()


def test_memory_turns_over(encoder, monkeypatch):
    """Generations fill, move over and drop out while texts go on; long pieces are not remembered."""
    monkeypatch.setattr(token_ids, "MEMORY_BYTES", 4_000)
    own = token_ids.Encoder(token_ids.tokenizer_path())
    for k in range(60):
        texts = [f"often {'long' * 40} w{k} w{k - 1} w{k // 2}  x", ""]
        ids, firsts = own.encode(texts, 0)
        want = own.tokenizer.encode(texts[0], add_special_tokens=False).ids + [0]
        assert ids[: firsts[1]].tolist() == want and ids[firsts[1]:].tolist() == [0]
    assert own.young.bytes + own.old.bytes < 20_000
    assert not any(len(piece) > token_ids.LONGEST_PIECE for piece in own.young.slots)
