"""The training loop: preprocessing, epochs, per-epoch metrics."""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.config import RunConfig
from ratingloom.model import FactorModel
from ratingloom.operators import factors, ordering, profiles
from ratingloom.operators.factors import RatingSkew
from ratingloom.operators.metrics import square_error
from ratingloom.plans import batch_gd, grid, local_sgd, strata
from ratingloom.plans.ledger import EpochLedger, fingerprint
from ratingloom.plans.parts import PartedRatings
from ratingloom.session import StagedTable, stage, task_slots

METRICS_SCHEMA = "iter int, train_rmse double, test_rmse double, epoch_seconds double"


@dataclass(frozen=True)
class Engine:
    """How a run is executed; none of it changes which ratings are used."""

    seed: int = 1
    # 'hash' spreads over all 64 bits; 'mix' is plain arithmetic that SQL can repeat; 'bijective' needs no sort.
    shuffle: str = "hash"
    # 'parity' draws what the minimal standard generator gives a serial program.
    init: str = "hash"
    # Blocks per side for stratified descent; None picks by data size and ``parallelism``.
    blocks: int | None = None
    # Blocks of stratified descent that should be able to run at once. Both decide the record order.
    parallelism: int = strata.PARALLELISM
    # Mini-batches are 'global', exact steps of one job each, or 'blockwise', steps inside blocks.
    batching: str = "global"
    # Train rows with very many records as averaged copies; otherwise every row is exact.
    split_hot: bool = False
    # Records per part of parallel descent; None picks what fits a task at the run's width.
    records_per_part: int | None = None
    # Keep the laid-out ratings cached on the executors between epochs.
    cache: bool = True


class _Scorer:
    """Errors (and batch gradients) of one rating set, by the plan that moves less data.

    A join moves one factor array per rating, a grid of B x B cells at most B per factor row.
    """

    def __init__(self, ratings: DataFrame, num_records: int, num_rows: int, width: int, skew: RatingSkew,
                 engine: Engine, precision: str):
        blocks = grid.grid_size(num_records, num_rows, width, task_slots(ratings.sparkSession))
        self._width = width
        self._skew = skew
        self._ratings = ratings
        self.cells = None
        if grid.pays_off(num_records, num_rows, width, blocks):
            self.cells = grid.grid_ratings(ratings, blocks, precision, engine.cache)

    def rmse(self, state: DataFrame) -> float | None:
        if self.cells:
            return grid.grid_square_error(self.cells, state, self._width).first().rmse
        return square_error(self._ratings, state, self._skew, self._width).first().rmse

    def descend(self, state: DataFrame, config: RunConfig, root: str | None, carry: tuple[str, ...] = ()) -> StagedTable:
        common = (config.num_features, config.learning_rate, config.regularization_factor, config.storage)
        if self.cells:
            return stage(grid.grid_epoch(self.cells, state, *common, carry), "factors", root=root)
        made: list[StagedTable] = []
        following = stage(batch_gd.gd_epoch(self._ratings, state, *common, self._skew, carry, made), "factors", root=root)
        for table in made:
            table.drop()
        return following

    def release(self) -> None:
        if self.cells:
            self.cells.release()
            self.cells.drop()


class _BlockScorer:
    """Errors of the ratings that are laid out for descent by strata: no other layout, and no join."""

    def __init__(self, ratings: strata.BlockedRatings, width: int):
        self._ratings = ratings
        self._width = width

    def rmse(self, state: DataFrame) -> float | None:
        return strata.square_error(self._ratings, state, self._width).first().rmse


class _Epochs:
    """The prepared ratings of one run and the step from one state to the next."""

    def __init__(self, config: RunConfig, engine: Engine, ratings: DataFrame, num_users: int, num_items: int,
                 num_records: int, skew: RatingSkew, scorer: _Scorer, ledger: EpochLedger | None = None):
        self.config = config
        self.skew = skew
        self.scorer = scorer
        self.plan = config.method
        self.layout = ""
        self.ledger = ledger
        # Batch descent meets all errors on its way: an epoch then tells the error of the state it began with.
        self.tells_error = self.plan == "gd" and bool(config.show_train_rmse) and ledger is None
        self.error_before: float | None = None
        self._cached = engine.cache
        self._root = ledger and ledger.path
        self._ratings = ratings
        self._owned: list = []
        self._batches = math.ceil(num_records / config.batch_size)
        if self.plan == "gd":
            return
        if self.plan == "minibatch":
            if engine.batching == "blockwise":
                self.plan = "blockwise_minibatch"
            elif self._batches > batch_gd.MAX_DATAFRAME_BATCHES:
                raise ValueError(f"{self._batches} global batches an epoch, at most "
                                 f"{batch_gd.MAX_DATAFRAME_BATCHES} are run; use Engine(batching='blockwise')")
        if not (ledger and self._kept(ledger, engine)):
            self._lay_out(ratings, engine, num_users, num_items, num_records)
        if isinstance(self._ratings, strata.BlockedRatings):
            blocks = self._ratings.blocks
            self.layout = f"{blocks} x {blocks} blocks" + ", frequent rows split" * self._ratings.split

    def _kept(self, ledger: EpochLedger, engine: Engine) -> bool:
        """Take up the layout that an earlier driver left in the ledger."""
        kept = ledger.layout()
        if kept is None:
            return False
        tables = {name: table and ledger.table(table) for name, table in kept["tables"].items()}
        if self.plan == "minibatch":
            self._ratings = tables["batched"].df
        elif self.plan in ("local_sgd", "row_sgd"):
            self._ratings = PartedRatings(tables["records"], tables["touched"], tables["hot"], kept["values"]["parts"],
                                          engine.cache)
        else:
            self._ratings = strata.BlockedRatings(tables, kept["values"]["blocks"], engine.cache)
        return True

    def _keep(self, values: dict, tables: dict) -> None:
        """Tables of the layout stay in the ledger, or go with the run."""
        if self.ledger:
            self.ledger.keep_layout(values, tables)
        else:
            self._owned += [table for table in tables.values() if table]

    def _lay_out(self, ratings: DataFrame, engine: Engine, num_users: int, num_items: int, num_records: int) -> None:
        config, width = self.config, self.config.num_features
        positioned = ordering.shuffled_positions(ratings, "rec_id", engine.seed, method=engine.shuffle)
        if self.plan == "minibatch":
            if engine.shuffle == "bijective" and ratings.agg(F.max("rec_id")).first()[0] != num_records - 1:
                raise ValueError("global batches by a bijection need record numbers without gaps")
            batched = ordering.batch_numbers(positioned, config.batch_size)
            table = stage(batched.repartitionByRange("batch", "rec_id"), "batched-ratings", ["batch"], self._root)
            self._ratings = table.df
            self._keep({}, {"batched": table})
        elif self.plan in ("local_sgd", "row_sgd"):
            size = engine.records_per_part or local_sgd.part_records(width)
            deduped = None
            if self.plan == "local_sgd":
                parts = local_sgd.parts_by_record(positioned, size)
            else:
                ordered = stage(positioned, "ordered-ratings")
                deduped = stage(profiles.dedupe_last(ordered.df, "pos"), "latest-ratings")
                ordered.drop()
                offsets = ordering.user_offsets(deduped.df, num_users, engine.seed, engine.shuffle)
                parts = local_sgd.parts_by_user(deduped.df, offsets, size, engine.split_hot)
            self._ratings = PartedRatings.of(parts, config.storage, cache=engine.cache, root=self._root)
            if deduped:
                deduped.drop()
            self._keep({"parts": self._ratings.num_parts}, self._ratings.tables)
        else:
            blocks = engine.blocks or strata.choose_blocks(num_records, num_users + num_items, width, engine.parallelism)
            self._ratings = strata.BlockedRatings.of(positioned, blocks, config.storage, engine.cache,
                                                     split_hot=engine.split_hot, root=self._root)
            self._keep({"blocks": blocks}, self._ratings.tables)

    def step(self, state: DataFrame) -> StagedTable:
        c = self.config
        common = (c.num_features, c.learning_rate, c.regularization_factor, c.storage)
        if self.tells_error:
            table = self.scorer.descend(state, c, self._root, ("square", "rated"))
            mean = F.try_divide(F.sum("square"), F.sum("rated"))
            self.error_before = table.df.agg(F.sqrt(mean).alias("rmse")).first().rmse
            return StagedTable(table.df.drop("square", "rated"), table.path)
        if self.plan == "gd":
            return self.scorer.descend(state, c, self._root)
        if self.plan == "minibatch":
            return batch_gd.minibatch_epoch(self._ratings, self._batches, state, *common, self.skew, self._root)
        if self.plan in ("local_sgd", "row_sgd"):
            return local_sgd.local_epoch(self._ratings, state, *common, self._root)
        return strata.stratified_epoch(self._ratings, state, c.method, *common, c.batch_size, self._root)

    def block_scorer(self, num_records: int, num_rows: int) -> _BlockScorer | None:
        """A scorer of the training ratings where they lie, if that moves less than joins; ratings unrounded."""
        if not (isinstance(self._ratings, strata.BlockedRatings) and self._cached and self.config.storage == "double"):
            return None
        if self._ratings.blocks * num_rows > num_records:
            return None
        return _BlockScorer(self._ratings, self.config.num_features)

    def release(self) -> None:
        if hasattr(self._ratings, "release"):
            self._ratings.release()
        for table in self._owned:
            table.drop()


def fit(train: DataFrame, test: DataFrame | None = None, config: RunConfig = RunConfig(),
        engine: Engine = Engine(), num_users: int | None = None, num_items: int | None = None,
        resume: str | None = None) -> FactorModel:
    """Factorize ``train`` (``rec_id, user_id, item_id, rating``) and report errors per epoch.

    The dimensions default to the largest ids of ``train`` plus one. Test records with ids
    outside them are left out of the test error.

    ``resume`` names a ledger folder on storage that outlives the driver. Every epoch is committed there,
    and a call with the same ratings, configuration and engine goes on behind the last committed one; with
    more epochs it trains a finished run further.
    """
    if engine.batching not in ("global", "blockwise"):
        raise ValueError("batching must be 'global' or 'blockwise'")
    spark = train.sparkSession
    # Laying out, counting and scoring all read the ratings: parse them once.
    columns = ("rec_id", "user_id", "item_id", "rating")
    inputs = [stage(df.select(*columns), name) for df, name in ((train, "train"), (test, "test")) if df is not None]
    try:
        return _fit(inputs[0].df, inputs[1].df if test is not None else None, config, engine, num_users, num_items,
                    EpochLedger(spark, resume) if resume else None)
    finally:
        for table in inputs:
            table.drop()


def _fit(train: DataFrame, test: DataFrame | None, config: RunConfig, engine: Engine, num_users: int | None,
         num_items: int | None, ledger: EpochLedger | None) -> FactorModel:
    spark = train.sparkSession
    size = profiles.dimensions(train).first()
    users = size.num_users if num_users is None else num_users
    items = size.num_items if num_items is None else num_items
    if size.num_users > users or size.num_items > items:
        raise ValueError(f"ids reach {size.num_users} x {size.num_items}, beyond {users} x {items}")
    if ledger:
        options = {**asdict(engine), "cache": None}
        ledger.open({"config": {**config.to_dict(), "max_num_iterations": None}, "engine": options,
                     "users": users, "items": items, "train": fingerprint(train),
                     "test": None if test is None else fingerprint(test)})

    owned: list = []
    state = None
    rows = [(c["epoch"], c["train"], c["test"], c["seconds"]) for c in ledger.commits()] if ledger else []

    def own(made):
        owned.append(made)
        return made

    def report(number: int, seconds: float | None) -> None:
        known_later = epochs.tells_error and number < config.max_num_iterations
        errors = {name: scorer.rmse(state.df) for name, scorer in scorers.items()
                  if name == "test" or config.show_train_rmse and not known_later}
        rows.append((number, errors.get("train"), errors.get("test"), seconds))
        if ledger:
            ledger.commit(number, state, {"train": errors.get("train"), "test": errors.get("test")}, seconds)

    try:
        skew = RatingSkew.staged(train)
        shape = (users + items, config.num_features, skew, engine, config.storage)
        scorers = {}
        if config.method == "gd":
            scorers["train"] = own(_Scorer(train, size.num_records, *shape))
        epochs = own(_Epochs(config, engine, train, users, items, size.num_records, skew, scorers.get("train"), ledger))
        if config.show_train_rmse and "train" not in scorers:
            scorers["train"] = (epochs.block_scorer(size.num_records, users + items)
                                or own(_Scorer(train, size.num_records, *shape)))
        if config.show_test_rmse and test is not None:
            scorers["test"] = own(_Scorer(test, test.count(), *shape))
        done, state = (ledger.last() if ledger else None) or (0, None)
        if state is None:
            state = stage(factors.init_state(spark, users, items, config.num_features, engine.init, config.storage,
                                             accumulators=config.method == "adagrad"), "factors",
                          root=ledger and ledger.path)
            report(0, None)
        for number in range(done + 1, config.max_num_iterations + 1):
            started = time.perf_counter()
            following = epochs.step(state.df)
            seconds = time.perf_counter() - started
            if epochs.tells_error:
                rows[-1] = (rows[-1][0], epochs.error_before, *rows[-1][2:])
            if not ledger:
                state.drop()
            state = following
            report(number, seconds)
    except BaseException:
        # What a ledger committed stays; the rest is swept when it is opened again.
        if state is not None and not ledger:
            state.drop()
        raise
    finally:
        for used in owned:
            used.release()
        skew.drop()
    reported = [row for row in rows if any(value is not None for value in row[1:])]
    return FactorModel(state.df, config, spark.createDataFrame(reported, METRICS_SCHEMA), epochs.plan, epochs.layout)
