"""Scores of a part are made chunk by chunk: their arrays do not grow with its records."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ratingloom.plans.exchange import BlockScore, list_column


def _part(count: int, rows: int = 50, width: int = 4):
    chance = np.random.default_rng(count)
    features = chance.random((2 * rows, width))
    keys = np.concatenate([chance.permutation(rows), chance.permutation(rows)])
    state = pa.table({"side": pa.array(np.repeat([0, 1], rows), pa.int32()), "key": pa.array(keys, pa.int64()),
                      "features": list_column(features)})
    ratings = chance.random(count)
    records = pa.table({"rec_id": np.arange(count), "user_key": chance.integers(0, rows, count),
                        "item_key": chance.integers(0, rows + 5, count),
                        "rating": pa.array(ratings, mask=chance.random(count) < 0.1)})
    return state, records


@pytest.mark.parametrize("method", ["gradients", "errors"])
def test_arrays_do_not_grow_with_records(method):
    peaks = []
    for count in (200_000, 800_000):
        state, records = _part(count)
        tracemalloc.start()
        getattr(BlockScore(4), method)(state, records)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0]


@pytest.mark.parametrize("count", [0, 40])
def test_chunks_lose_nothing(count):
    state, records = _part(count)
    score = BlockScore(4)
    score.chunk = 7
    rows = {(s, k): np.array(f) for s, k, f in zip(*(state.column(c).to_pylist() for c in ("side", "key", "features")))}
    known = [r for r in records.to_pylist() if (1, r["item_key"]) in rows]
    dots = {r["rec_id"]: rows[0, r["user_key"]] @ rows[1, r["item_key"]] for r in known}
    scored = score.predictions(state, records).to_pylist()
    assert [(r["rec_id"], r["rating"]) for r in scored] == [(r["rec_id"], r["rating"]) for r in known]
    assert [r["prediction"] for r in scored] == pytest.approx(list(dots.values()))
    rated = [r for r in known if r["rating"] is not None]
    squares = sum((dots[r["rec_id"]] - r["rating"]) ** 2 for r in rated)
    assert score.errors(state, records).to_pylist() == [{"square_error_sum": pytest.approx(squares), "num_records": len(rated)}]
    expected = {}
    for r in rated:
        for own, other in (((0, r["user_key"]), (1, r["item_key"])), ((1, r["item_key"]), (0, r["user_key"]))):
            expected[own] = expected.get(own, 0) + (dots[r["rec_id"]] - r["rating"]) * rows[other]
    got = score.gradients(state, records).to_pylist()
    assert {(g["side"], g["key"]): g["gradient"] for g in got} == {k: pytest.approx(list(v)) for k, v in expected.items()}
    assert sum(g["rated"] for g in got) == len(rated) and sum(g["square"] for g in got) == pytest.approx(squares)
