"""Runs that break and go on from their ledger."""

from __future__ import annotations

import os

import numpy as np
import pytest

from ratingloom import Engine, RunConfig, fit
from ratingloom.plans import training
from ratingloom.plans.ledger import EpochLedger
from ratingloom.session import Folder

MODES = {
    "sgd": dict(gd_mode=1, decomp_mode=2, precision=0), "adagrad": dict(gd_mode=2), "gd": dict(gd_mode=0),
    "local_sgd": dict(gd_mode=1, decomp_mode=0), "minibatch": dict(gd_mode=1, batch_size=300),
}


@pytest.fixture
def data(make_ratings):
    rng = np.random.default_rng(5)
    rows = [(int(u), int(i), float(r)) for u, i, r in
            zip(rng.integers(0, 20, 400), rng.integers(0, 15, 400), rng.integers(1, 6, 400))]
    return make_ratings(rows[:360]), make_ratings(rows[360:])


def configured(mode, epochs=4):
    return RunConfig(**{"num_features": 3, "learning_rate": 0.05, "regularization_factor": 0.02, "precision": 2,
                        "max_num_iterations": epochs, "show_test_rmse": 1, **MODES[mode]})


def values(model):
    lists = [c for c in ("features", "acc") if c in model.state.columns]
    return {(r.side, r.id): [list(r[c]) for c in lists] for r in model.state.collect()}


def breaking(monkeypatch, epoch):
    """Let the step of ``epoch`` fail, counted over all calls of ``fit``."""
    calls = []
    step = training._Epochs.step

    def failing(self, state):
        calls.append(1)
        if len(calls) == epoch:
            raise RuntimeError("lost")
        return step(self, state)

    monkeypatch.setattr(training._Epochs, "step", failing)
    return calls


@pytest.mark.parametrize("mode", list(MODES))
def test_broken_run_equals_unbroken(data, tmp_path, monkeypatch, mode):
    engine = Engine(blocks=2, records_per_part=90, init="mix", shuffle="mix")
    whole = fit(*data, configured(mode), engine)
    expected, trace = values(whole), whole.metrics.drop("epoch_seconds").collect()
    path = str(tmp_path / "run")
    calls = breaking(monkeypatch, 3)
    engine = Engine(blocks=2, records_per_part=90, init="mix", shuffle="mix", cache=False)
    with pytest.raises(RuntimeError, match="lost"):
        fit(*data, configured(mode), engine, resume=path)
    left = os.listdir(f"{path}/ratingloom")
    resumed = fit(*data, configured(mode), engine, resume=path)
    # Two epochs, the failing one, and only the two that were missing.
    assert len(calls) == 5
    found = values(resumed)
    assert found.keys() == expected.keys()
    exact = mode in ("sgd", "adagrad")
    for key in found:
        for a, b in zip(found[key], expected[key]):
            assert a == b if exact else np.allclose(a, b, rtol=0, atol=1e-9)
    for a, b in zip(resumed.metrics.collect(), trace, strict=True):
        assert (a.iter, a.test_rmse) == (b.iter, pytest.approx(b.test_rmse, abs=1e-9))
    # The layout was taken up, not made again.
    layouts = [n for n in left if n.startswith(("blocked", "parted", "batched", "touched"))]
    assert layouts == [n for n in left if n in os.listdir(f"{path}/ratingloom") and n in layouts]


def test_finished_run_goes_further_and_others_are_refused(data, tmp_path):
    engine = Engine(blocks=2, init="mix", shuffle="mix")
    path = str(tmp_path / "run")
    again = fit(*data, configured("adagrad", 1), engine, resume=path)
    assert [r.iter for r in again.metrics.collect()] == [0, 1]
    further = fit(*data, configured("adagrad", 2), engine, resume=path)
    assert [r.iter for r in further.metrics.collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="config"):
        fit(*data, configured("sgd", 1), engine, resume=path)
    with pytest.raises(ValueError, match="engine"):
        fit(*data, configured("adagrad", 1), Engine(blocks=3), resume=path)
    with pytest.raises(ValueError, match="train"):
        fit(data[0].where("rec_id > 0"), data[1], configured("adagrad", 1), engine, resume=path)


def test_only_named_tables_stay(spark, data, tmp_path):
    engine, path = Engine(blocks=2), str(tmp_path / "run")
    os.makedirs(f"{path}/ratingloom/factors-of-a-dead-run")
    fit(*data, configured("sgd", 1), engine, resume=path)
    names = os.listdir(f"{path}/ratingloom")
    assert len([n for n in names if n.startswith("factors")]) == 1
    ledger = EpochLedger(spark, path)
    assert [c["epoch"] for c in ledger.commits()] == [0, 1]
    ledger.drop()
    assert not os.path.exists(path)


def test_marks_are_written_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "marks"))
    folder.write("a/one.json", "1")
    with pytest.raises(FileExistsError):
        folder.write("a/one.json", "2")
    assert folder.read("a/one.json") == "1" and folder.names("a") == ["one.json"]
    assert folder.read("a/two.json") is None and folder.names("b") == []
