"""A table of runs trained together: one layout and one scan of the ratings an epoch, however many runs.

A factor row holds the features of all runs that are still training, one run after the other. A pass over
the ratings meets each factor row once and applies every run's own rule, rate and width to its part. A run
that has reached its target, or its number of epochs, leaves, and its part is cut out of the rows.

Runs that need the same kind of pass go together: batch descent; one-by-one, adaptive and blockwise
descent by strata; parts by record; parts by user. So a table costs at most four passes an epoch.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.config import RunConfig
from ratingloom.functions.arrays import array_type, dot, scaled, sum_arrays
from ratingloom.functions.half import rounded_features
from ratingloom.model import FactorModel
from ratingloom.operators import factors, ordering, profiles
from ratingloom.operators.factors import ITEM, USER, RatingSkew, attach_factors
from ratingloom.plans import local_sgd, strata
from ratingloom.plans.exchange import BlockUpdate, RunsUpdate
from ratingloom.plans.parts import PartedRatings
from ratingloom.plans.training import Engine
from ratingloom.session import StagedTable, stage

TRACE_SCHEMA = "run string, iter int, train_rmse double, test_rmse double, epoch_seconds double"
#: Which pass over the ratings a method needs.
FAMILIES = {"gd": "batch", "sgd": "strata", "adagrad": "strata", "minibatch": "strata",
            "local_sgd": "records", "row_sgd": "users"}


@dataclass(frozen=True)
class Run:
    """One row of the table; ``target`` is the test error at which it stops."""

    name: str
    config: RunConfig
    target: float | None = None

    @property
    def adaptive(self) -> bool:
        return self.config.method == "adagrad"

    def update(self) -> BlockUpdate:
        c = self.config
        return BlockUpdate({"local_sgd": "sgd", "row_sgd": "sgd"}.get(c.method, c.method), c.num_features,
                           float(c.learning_rate), float(c.regularization_factor), c.storage, c.batch_size)


def read_runs(runs: DataFrame) -> list[Run]:
    """The rows of a run table, a row for each configuration file: ``run``, parameters, maybe ``target_rmse``."""
    rows = runs.orderBy("run").toArrow().to_pylist()
    names = [row["run"] for row in rows]
    if len(set(names)) < len(names):
        raise ValueError("two runs have the same name")
    return [Run(row["run"], RunConfig.from_row(row), row.get("target_rmse")) for row in rows]


class RunState:
    """Factor rows ``(side, id, features[, acc])`` of several runs, always as doubles."""

    def __init__(self, runs: list[Run], table: StagedTable):
        self.runs = runs
        self.table = table

    @classmethod
    def initial(cls, spark, runs: list[Run], num_users: int, num_items: int, method: str) -> RunState:
        """Every run starts from the values it would start from alone."""
        widest = max(run.config.num_features for run in runs)
        rows = factors.init_state(spark, num_users, num_items, widest, method)
        parts = [_as_double(rounded_features(F.slice("features", 1, run.config.num_features), run.config.storage))
                 for run in runs]
        sums = sum(run.config.num_features for run in runs if run.adaptive)
        acc = [F.array_repeat(F.lit(0.0).cast("double"), sums).alias("acc")] if sums else []
        return cls(runs, stage(rows.select("side", "id", F.concat(*parts).alias("features"), *acc), "run-factors"))

    def part(self, run: Run, column: str = "features", source: str | None = None) -> Column:
        """A run's part of an array that is laid out like ``column``, in the run's storage type."""
        begin = 1
        for other in self.runs:
            if other.name == run.name:
                break
            begin += other.config.num_features if column == "features" or other.adaptive else 0
        return F.slice(source or column, begin, run.config.num_features).cast(array_type(run.config.storage))

    def of(self, run: Run) -> DataFrame:
        """The run's own state."""
        acc = [self.part(run, "acc").alias("acc")] if run.adaptive else []
        return self.table.df.select("side", "id", self.part(run).alias("features"), *acc)

    def only(self, runs: list[Run]) -> RunState:
        """Without the parts of the runs that left; nothing is written for it."""
        if len(runs) == len(self.runs):
            return self
        lists = [F.concat(*(_as_double(self.part(run)) for run in runs)).alias("features")]
        adaptive = [run for run in runs if run.adaptive]
        if adaptive:
            lists.append(F.concat(*(_as_double(self.part(run, "acc")) for run in adaptive)).alias("acc"))
        return RunState(runs, StagedTable(self.table.df.select("side", "id", *lists), self.table.path))

    def product(self, run: Run) -> Column:
        """The inner product of a run's parts of ``p`` and ``q``."""
        width = run.config.num_features
        return dot(self.part(run, source="p"), self.part(run, source="q"), width)

    def errors(self, records: DataFrame, skew: RatingSkew) -> dict[str, float | None]:
        """Each run's RMSE on ``records``, in one pass."""
        joined = attach_factors(records, self.table.df, skew)
        sums = []
        for k, run in enumerate(self.runs):
            error = self.product(run) - F.col("rating")
            sums.append(F.sqrt(F.avg(error * error)).alias(f"r{k}"))
        row = joined.agg(*sums).first()
        return {run.name: row[k] for k, run in enumerate(self.runs)}


def _as_double(values: Column) -> Column:
    return values.cast("array<double>")


def batch_step(state: RunState, ratings: DataFrame, skew: RatingSkew) -> StagedTable:
    """One step of batch descent of every run over all records."""
    errors = {f"_error{k}": state.product(run) - F.col("rating") for k, run in enumerate(state.runs)}
    joined = attach_factors(ratings, state.table.df, skew).withColumns(errors)
    terms = {USER: [], ITEM: []}
    for error, run in zip(errors, state.runs):
        for side, other in ((USER, "q"), (ITEM, "p")):
            terms[side].append(scaled(F.col(error), state.part(run, source=other), run.config.num_features))
    rows = joined.select(F.inline(F.array(*(
        F.struct(F.lit(side).alias("side"), F.col(key).alias("id"), F.concat(*terms[side]).alias("gradient"))
        for side, key in ((USER, "user_id"), (ITEM, "item_id"))))))
    width = sum(run.config.num_features for run in state.runs)
    gradients = sum_arrays(rows, ["side", "id"], "gradient", width)
    moved = []
    begin = 1
    for run in state.runs:
        c = run.config
        gradient = F.slice("gradient", begin, c.num_features)
        begin += c.num_features
        moved.append(_as_double(rounded_features(_descended(state.part(run), gradient, c), c.storage)))
    stepped = F.when(F.col("gradient").isNull(), F.col("features")).otherwise(F.concat(*moved))
    joined = state.table.df.join(gradients, ["side", "id"], "left")
    return stage(joined.select("side", "id", stepped.alias("features")), "run-factors")


def _descended(values: Column, gradient: Column, config: RunConfig) -> Column:
    rate, penalty = F.lit(float(config.learning_rate)), F.lit(float(config.regularization_factor))
    return F.zip_with(values, gradient, lambda x, g: x - rate * (g + penalty * x))


class _Pass:
    """The laid-out ratings of one family and its step."""

    def __init__(self, family: str, runs: list[Run], ratings: DataFrame, engine: Engine, num_users: int, num_items: int,
                 num_records: int, skew: RatingSkew):
        self.family = family
        self.skew = skew
        self.ratings = ratings
        width = sum(run.config.num_features for run in runs)
        if family == "batch":
            return
        if family == "strata" and engine.batching != "blockwise" and any(r.config.method == "minibatch" for r in runs):
            raise ValueError("runs with mini-batches share a pass only with Engine(batching='blockwise')")
        positioned = ordering.shuffled_positions(ratings, "rec_id", engine.seed, method=engine.shuffle)
        if family == "strata":
            blocks = engine.blocks or strata.choose_blocks(num_records, num_users + num_items, width, engine.parallelism)
            self.ratings = strata.BlockedRatings.of(positioned, blocks, "double", engine.cache)
            return
        size = engine.records_per_part or local_sgd.part_records(width)
        if family == "records":
            parts = local_sgd.parts_by_record(positioned, size)
        else:
            deduped = profiles.dedupe_last(positioned, "pos")
            offsets = ordering.user_offsets(deduped, num_users, engine.seed, engine.shuffle)
            parts = local_sgd.parts_by_user(deduped, offsets, size, engine.split_hot)
        self.ratings = PartedRatings.of(parts, "double", cache=engine.cache)

    def step(self, state: RunState) -> StagedTable:
        if self.family == "batch":
            return batch_step(state, self.ratings, self.skew)
        update = RunsUpdate([run.update() for run in state.runs])
        if self.family == "strata":
            return strata.stratified_pass(self.ratings, state.table.df, update, "double")

        def rounding(mean: Column) -> Column:
            begin, parts = 1, []
            for run in state.runs:
                part = F.slice(mean, begin, run.config.num_features)
                parts.append(_as_double(rounded_features(part, run.config.storage)))
                begin += run.config.num_features
            return F.concat(*parts)

        return local_sgd.local_pass(self.ratings, state.table.df, update, "double", rounding)

    def release(self) -> None:
        if self.family != "batch":
            self.ratings.release()
            self.ratings.drop()


class TrainedRuns:
    """``traces`` is ``(run, iter, train_rmse, test_rmse, epoch_seconds)``; ``models`` by the name of the run."""

    def __init__(self, traces: DataFrame, models: dict[str, FactorModel], passes: int):
        self.traces = traces
        self.models = models
        self.passes = passes


def fit_runs(train: DataFrame, test: DataFrame | None, runs: DataFrame, engine: Engine = Engine(),
             num_users: int | None = None, num_items: int | None = None) -> TrainedRuns:
    """Train every run of a table on the same ratings (see ``training.fit`` and ``sources.run_config``).

    A run with ``target_rmse`` stops after the first epoch whose test error is at or below it; it needs
    ``show_test_rmse``. A run gives what it gives alone, as long as ``Engine`` fixes the blocks and the
    records a part, which else follow from the width of all runs together.
    """
    spark = train.sparkSession
    table = read_runs(runs)
    columns = ("rec_id", "user_id", "item_id", "rating")
    inputs = [stage(df.select(*columns), name) for df, name in ((train, "train"), (test, "test")) if df is not None]
    train, test = inputs[0].df, inputs[1].df if test is not None else None
    size = profiles.dimensions(train).first()
    users = size.num_users if num_users is None else num_users
    items = size.num_items if num_items is None else num_items
    skew = RatingSkew.staged(train)
    rows: list[tuple] = []
    models: dict[str, FactorModel] = {}
    passes = 0
    try:
        for family in dict.fromkeys(FAMILIES.values()):
            members = [run for run in table if FAMILIES[run.config.method] == family]
            if not members:
                continue
            laid_out = _Pass(family, members, train, engine, users, items, size.num_records, skew)
            state = RunState.initial(spark, members, users, items, engine.init)
            number, seconds = 0, None
            try:
                while True:
                    errors = {"train": {}, "test": {}}
                    for name, records, flag in (("train", train, "show_train_rmse"), ("test", test, "show_test_rmse")):
                        asked = [run for run in state.runs if getattr(run.config, flag)]
                        if asked and records is not None:
                            errors[name] = state.only(asked).errors(records, skew)
                    staying = []
                    for run in state.runs:
                        trained, tested = errors["train"].get(run.name), errors["test"].get(run.name)
                        if seconds is not None or trained is not None or tested is not None:
                            rows.append((run.name, number, trained, tested, seconds))
                        reached = run.target is not None and tested is not None and tested <= run.target
                        if reached or number >= run.config.max_num_iterations:
                            models[run.name] = FactorModel(state.of(run), run.config, plan=run.config.method)
                        else:
                            staying.append(run)
                    if not staying:
                        break
                    # The table of a run that left stays for its model; else it goes after the step.
                    kept = len(staying) < len(state.runs)
                    state = state.only(staying)
                    started = time.perf_counter()
                    following = laid_out.step(state)
                    seconds, number, passes = time.perf_counter() - started, number + 1, passes + 1
                    if not kept:
                        state.table.drop()
                    state = RunState(staying, following)
            finally:
                laid_out.release()
    finally:
        skew.drop()
        for used in inputs:
            used.drop()
    return TrainedRuns(spark.createDataFrame(rows, TRACE_SCHEMA), models, passes)
