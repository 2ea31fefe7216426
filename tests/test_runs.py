"""A table of runs next to the same runs one by one."""

from __future__ import annotations

import numpy as np
import pytest

from ratingloom import Engine, RunConfig, fit
from ratingloom.plans import runs as run_tables
from ratingloom.plans.runs import fit_runs

ENGINE = Engine(blocks=2, records_per_part=90, init="mix", shuffle="mix", batching="blockwise")
COMMON = {"regularization_factor": 0.02, "show_train_rmse": 1, "show_test_rmse": 1, "precision": 2}
RUNS = {
    "gd-slow": dict(gd_mode=0, num_features=3, learning_rate=0.01, max_num_iterations=3),
    "gd-fast": dict(gd_mode=0, num_features=5, learning_rate=0.05, max_num_iterations=2),
    "gd-single": dict(gd_mode=0, num_features=2, learning_rate=0.05, max_num_iterations=1, precision=1),
    "sgd": dict(gd_mode=1, decomp_mode=2, num_features=2, learning_rate=0.05, max_num_iterations=1),
    "adagrad": dict(gd_mode=2, num_features=4, learning_rate=0.1, max_num_iterations=2),
    "adagrad-half": dict(gd_mode=2, num_features=3, learning_rate=0.1, max_num_iterations=1, precision=0),
    "batches": dict(gd_mode=1, batch_size=16, num_features=3, learning_rate=0.05, max_num_iterations=1),
    "parts-half": dict(gd_mode=1, decomp_mode=0, num_features=2, learning_rate=0.05, max_num_iterations=1, precision=0),
    "rows": dict(gd_mode=1, decomp_mode=1, num_features=3, learning_rate=0.05, max_num_iterations=1),
}


@pytest.fixture
def data(make_ratings):
    rng = np.random.default_rng(9)
    rows = [(int(u), int(i), float(r)) for u, i, r in
            zip(rng.integers(0, 20, 400), rng.integers(0, 15, 400), rng.integers(1, 6, 400))]
    return make_ratings(rows[:360]), make_ratings(rows[360:])


def table(spark, runs, targets=()):
    targets = dict(targets)
    rows = [{"run": name, **RunConfig(**{**COMMON, **values}).to_dict(), "target_rmse": targets.get(name)}
            for name, values in runs.items()]
    names = list(rows[0])
    kinds = ["string"] + ["double" if n in ("learning_rate", "regularization_factor", "target_rmse") else "int" for n in names[1:]]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(map(" ".join, zip(names, kinds))))


def values(model):
    lists = [c for c in ("features", "acc") if c in model.state.columns]
    return {(r.side, r.id): [list(r[c]) for c in lists] for r in model.state.collect()}


def test_every_run_equals_itself_alone(spark, data):
    trained = fit_runs(*data, table(spark, RUNS), ENGINE)
    assert set(trained.models) == set(RUNS)
    traces = {}
    for row in trained.traces.collect():
        traces.setdefault(row.run, []).append((row.iter, row.train_rmse, row.test_rmse))
    for name, given in RUNS.items():
        if name in ("gd-slow", "sgd"):
            continue  # their like is compared
        alone = fit(*data, RunConfig(**{**COMMON, **given}), ENGINE)
        mine, expected = values(trained.models[name]), values(alone)
        assert mine.keys() == expected.keys(), name
        for key in mine:
            for a, b in zip(mine[key], expected[key], strict=True):
                assert np.allclose(a, b, rtol=0, atol=1e-6 if given.get("precision") == 1 else 1e-9), name
        trace = [(r.iter, r.train_rmse, r.test_rmse) for r in alone.metrics.collect()]
        assert np.allclose(sorted(traces[name]), trace, rtol=0, atol=1e-6), name


def test_run_leaves_at_its_target(spark, data):
    two = {name: dict(gd_mode=0, num_features=3, learning_rate=0.01, max_num_iterations=4) for name in ("early", "late")}
    free = fit(*data, RunConfig(**{**COMMON, **two["late"]}), ENGINE)
    errors = [r.test_rmse for r in free.metrics.collect()]
    goal = (errors[1] + errors[2]) / 2
    trained = fit_runs(*data, table(spark, two, {"early": goal}), ENGINE)
    last = {r.run: r.last for r in trained.traces.groupBy("run").agg({"iter": "max"}).toDF("run", "last").collect()}
    assert last == {"early": 2, "late": 4}
    shorter = fit(*data, RunConfig(**{**COMMON, **two["early"], "max_num_iterations": 2}), ENGINE)
    for key, row in values(shorter).items():
        assert np.allclose(values(trained.models["early"])[key], row, rtol=0, atol=1e-12)


def test_scans_do_not_grow_with_the_runs(spark, data, monkeypatch):
    """The ratings are joined with factors as often for five runs as for one."""
    calls = []
    attach = run_tables.attach_factors

    def counted(*args, **kwargs):
        calls.append(1)
        return attach(*args, **kwargs)

    monkeypatch.setattr(run_tables, "attach_factors", counted)
    counts = []
    for number in (1, 5):
        calls.clear()
        runs = {f"r{k}": dict(gd_mode=0, num_features=2, learning_rate=0.01 * (k + 1), max_num_iterations=2) for k in range(number)}
        assert fit_runs(*data, table(spark, runs), ENGINE).passes == 2
        counts.append(len(calls))
    assert counts[0] == counts[1]


def test_bad_tables(spark, data):
    double = table(spark, {"a": RUNS["sgd"]})
    with pytest.raises(ValueError, match="same name"):
        fit_runs(*data, double.union(double), ENGINE)
    with pytest.raises(ValueError, match="blockwise"):
        fit_runs(*data, table(spark, {"b": RUNS["batches"]}), Engine())
