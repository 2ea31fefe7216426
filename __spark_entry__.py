"""

Every query runs over the whole rating table that ``ratingloom.fixtures`` derives from
``lineitem`` and ``orders`` (or over ``embeddings``), whatever the scale factor.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from ratingloom import Engine, FactorModel, RunConfig, fit, fit_runs, fixtures, read_ratings, read_run_configs, read_targets  # noqa: E402
from ratingloom.functions.half import array_to_half  # noqa: E402
from ratingloom.operators import factors, gradients, metrics, ordering, profiles  # noqa: E402
from ratingloom.plans import batch_gd, feature_shards, grid, local_sgd, strata  # noqa: E402
from ratingloom.plans.parts import PartedRatings  # noqa: E402
from ratingloom.session import Folder, shared_root, stage, task_slots  # noqa: E402
from ratingloom.sources.factor_text import factor_lines  # noqa: E402
from ratingloom.sources.ratings import check_ratings  # noqa: E402

WIDTH = oracles.WIDTH
RATE = oracles.RATE
SGD_RATE = oracles.SGD_RATE
ADAPTIVE_RATE = oracles.ADAPTIVE_RATE
PENALTY = oracles.PENALTY
SEED = oracles.SEED
BLOCKS = oracles.BLOCKS
RECORDS_PER_PART = oracles.RECORDS_PER_PART
BATCHES = oracles.BATCHES


def _dims(ratings: DataFrame):
    return profiles.dimensions(ratings).first()


def _start(ratings: DataFrame, width: int = WIDTH, precision: str = "double", accumulators: bool = False) -> DataFrame:
    size = _dims(ratings)
    return factors.init_state(ratings.sparkSession, size.num_users, size.num_items, width,
                              precision=precision, accumulators=accumulators)


def _values(state: DataFrame, column: str = "features") -> DataFrame:
    """``(side, id, k, value)``, rounded for comparison."""
    return factors.explode_features(state, "side", "id", column=column).select(
        "side", "id", "k", F.round(F.col("value").cast("double"), 6).alias("value"))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/ratingloom/{name}-{uuid.uuid4().hex}"


# Sources

def scan_coo_text(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    size = _dims(records)
    path = fixtures.write_coo_text(records, size, _scratch(spark, "coo") + ".txt", files=fixtures.file_count(size.num_records))
    return read_ratings(spark, path).ratings.withColumn("rating", F.col("rating").cast("double"))


def scan_coo_text_one_based(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    shifted = records.withColumns({"user_id": F.col("user_id") + 1, "item_id": F.col("item_id") + 1})
    size = _dims(records)
    path = fixtures.write_coo_text(shifted, size, _scratch(spark, "coo") + ".txt", files=fixtures.file_count(size.num_records))
    return read_ratings(spark, path, id_base=1).ratings.withColumn("rating", F.col("rating").cast("double"))


def scan_coo_binary(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    size = _dims(records)
    path = fixtures.write_coo_binary(records, size, _scratch(spark, "coo") + ".bin", "narrow", 0, files=fixtures.file_count(size.num_records))
    return read_ratings(spark, path).ratings.withColumn("rating", F.col("rating").cast("double"))


def scan_coo_binary_range(spark, sf_dir):
    """A range of record numbers; byte ranges of the files outside it are not opened."""
    records = fixtures.ratings(spark, sf_dir)
    size = _dims(records)
    path = fixtures.write_coo_binary(records, size, _scratch(spark, "coo") + ".bin", "narrow", 0, files=fixtures.file_count(size.num_records))
    ratings = read_ratings(spark, path).ratings.where(F.col("rec_id").between(size.num_records // 5, size.num_records // 2))
    return ratings.withColumn("rating", F.col("rating").cast("double"))


def scan_coo_binary_wide(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    size = _dims(records)
    path = fixtures.write_coo_binary(records, size, _scratch(spark, "coo") + ".bin", "wide", 1, files=fixtures.file_count(size.num_records))
    ratings = read_ratings(spark, path, layout="wide").ratings
    return ratings.withColumn("rating", F.col("rating").cast("double"))


def check_ratings_query(spark, sf_dir):
    # The dimensions of the training part: ids of the other records may exceed them.
    records = fixtures.ratings(spark, sf_dir)
    return check_ratings(records, profiles.dimensions(fixtures.train(spark, sf_dir)))


# Projections, predictions, factor tables

def rebase_ids(spark, sf_dir):
    return profiles.rebase_ids(fixtures.ratings(spark, sf_dir), 1)


def init_factors(spark, sf_dir):
    return _values(_start(fixtures.ratings(spark, sf_dir)))


def init_factors_parity(spark, sf_dir):
    """The start of a serial program that draws from the minimal standard generator."""
    size = _dims(fixtures.ratings(spark, sf_dir))
    state = factors.init_state(spark, size.num_users, size.num_items, WIDTH, "parity", "single")
    return factors.explode_features(state, "side", "id").select(
        "side", "id", "k", F.round(F.col("value").cast("double"), 10).alias("value"))


def predict(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    scored = factors.predict(records, _start(records))
    return scored.select("rec_id", F.round("prediction", 6).alias("prediction"))


def predict_wide(spark, sf_dir):
    """At the width of the published runs."""
    records = fixtures.ratings(spark, sf_dir)
    scored = factors.predict(records, _start(records, oracles.PUBLISHED_WIDTH), width=oracles.PUBLISHED_WIDTH)
    return scored.select("rec_id", F.round("prediction", 6).alias("prediction"))


def _skewed(records: DataFrame) -> DataFrame:
    """Half of the records moved to one user, a third to one item; all records are kept."""
    return records.withColumns({"user_id": F.when(F.col("rec_id") % 2 == 0, 0).otherwise(F.col("user_id")),
                                "item_id": F.when(F.col("rec_id") % 3 == 0, 0).otherwise(F.col("item_id"))})


def predict_skewed(spark, sf_dir):
    """Hot ids are counted first and their joins salted."""
    records = _skewed(fixtures.ratings(spark, sf_dir))
    skew = factors.RatingSkew.staged(records, min_rows=oracles.HOT_ROWS)
    scored = factors.predict(records, _start(records), skew)
    return scored.select("rec_id", F.round("prediction", 6).alias("prediction"))


def residuals(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    scored = factors.predict(records, _start(records))
    return scored.select("rec_id", F.round("residual", 6).alias("residual"))


def quantize_half(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rounded = table.select("vec_id", array_to_half(F.col("embedding")).alias("features"))
    return factors.explode_features(rounded, "vec_id")


def export_factors(spark, sf_dir):
    state = _start(fixtures.ratings(spark, sf_dir))
    users = factor_lines(factors.side_of(state, factors.USER)).select(F.lit(0).alias("side"), "id", "line")
    items = factor_lines(factors.side_of(state, factors.ITEM)).select(F.lit(1).alias("side"), "id", "line")
    return users.unionByName(items)


# Metrics

def square_error_sum(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    total = metrics.square_error(records, _start(records))
    return total.select(F.round("square_error_sum", 4).alias("square_error_sum"), "num_records")


def square_error_exact(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    total = metrics.square_error_exact(records, _start(records))
    return total.select(F.round("square_error_sum", 4).alias("square_error_sum"), "num_records")


def train_rmse(spark, sf_dir):
    train = fixtures.train(spark, sf_dir)
    return metrics.square_error(train, _start(train)).select(F.round("rmse", 6).alias("train_rmse"))


def test_rmse(spark, sf_dir):
    train = fixtures.train(spark, sf_dir)
    return metrics.square_error(fixtures.test(spark, sf_dir), _start(train)).select(
        F.round("rmse", 6).alias("test_rmse"))


# Gradients and batch descent

def _gradients(spark, sf_dir, side):
    train = fixtures.train(spark, sf_dir)
    sums = gradients.gradient_sums(train, _start(train), WIDTH).where(F.col("side") == side)
    return _values(sums, "gradient").drop("side")


def user_gradients(spark, sf_dir):
    return _gradients(spark, sf_dir, factors.USER)


def item_gradients(spark, sf_dir):
    return _gradients(spark, sf_dir, factors.ITEM)


def gd_epoch(spark, sf_dir):
    train = fixtures.train(spark, sf_dir)
    return _values(batch_gd.gd_epoch(train, _start(train), WIDTH, RATE, PENALTY))


def gd_epoch_feature_sharded(spark, sf_dir):
    """At the published width, with rows cut into slices of 32 features."""
    train = fixtures.train(spark, sf_dir)
    slices = feature_shards.sliced(_start(train, oracles.PUBLISHED_WIDTH))
    done = feature_shards.sharded_epoch(train, slices, feature_shards.SLICE_WIDTH, RATE, PENALTY)
    return done.select("side", "id", "shard", F.posexplode("features").alias("place", "value")).select(
        "side", "id", (F.col("shard") * feature_shards.SLICE_WIDTH + F.col("place")).alias("k"),
        F.round("value", 6).alias("value"))


def _cells(records: DataFrame, size) -> PartedRatings:
    blocks = grid.grid_size(size.num_records, size.num_users + size.num_items, WIDTH, task_slots(records.sparkSession))
    return grid.grid_ratings(records, blocks)


def gd_epoch_grid(spark, sf_dir):
    train = fixtures.train(spark, sf_dir)
    return _values(grid.grid_epoch(_cells(train, _dims(train)), _start(train), WIDTH, RATE, PENALTY))


def gd_epoch_wide(spark, sf_dir):
    width = oracles.PUBLISHED_WIDTH
    train = fixtures.train(spark, sf_dir)
    return _values(batch_gd.gd_epoch(train, _start(train, width), width, RATE, PENALTY))


def gd_epoch_grid_skewed(spark, sf_dir):
    train = _skewed(fixtures.train(spark, sf_dir))
    return _values(grid.grid_epoch(_cells(train, _dims(train)), _start(train), WIDTH, RATE, PENALTY))


def predict_grid(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    scored = grid.grid_predict(_cells(records, _dims(records)), _start(records), WIDTH)
    return scored.select("rec_id", F.round("prediction", 6).alias("prediction"))


def test_rmse_grid(spark, sf_dir):
    train, test = fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir)
    error = grid.grid_square_error(_cells(test, _dims(test)), _start(train), WIDTH)
    return error.select(F.round("rmse", 6).alias("test_rmse"))


def minibatch_epoch(spark, sf_dir):
    train = fixtures.train(spark, sf_dir)
    size = -(-_dims(train).num_records // BATCHES)
    ordered = ordering.shuffled_positions(train, "rec_id", SEED)
    batched = stage(ordering.batch_numbers(ordered, size), "batched", ["batch"]).df
    return _values(batch_gd.minibatch_epoch(batched, BATCHES, _start(train), WIDTH, RATE, PENALTY).df)


def gd_trace(spark, sf_dir):
    config = RunConfig(gd_mode=0, num_features=WIDTH, learning_rate=RATE, regularization_factor=PENALTY,
                       max_num_iterations=3, precision=2, show_train_rmse=1, show_test_rmse=1)
    model = fit(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir), config, Engine(init="mix"))
    return model.metrics.select("iter", F.round("train_rmse", 6).alias("train_rmse"),
                                F.round("test_rmse", 6).alias("test_rmse"))


def _trained(spark, sf_dir):
    config = RunConfig(gd_mode=0, num_features=WIDTH, learning_rate=RATE, regularization_factor=PENALTY,
                       max_num_iterations=2, precision=2)
    return fit(fixtures.train(spark, sf_dir), None, config, Engine(init="mix"))


def predict_trained(spark, sf_dir):
    scored = _trained(spark, sf_dir).predict(fixtures.test(spark, sf_dir))
    return scored.select("rec_id", F.round("prediction", 6).alias("prediction"))


def model_round_trip(spark, sf_dir):
    path = _scratch(spark, "model")
    _trained(spark, sf_dir).save(path)
    return _values(FactorModel.load(spark, path).state)


def factor_text_round_trip(spark, sf_dir):
    """The written lines of both tables, each with how often it occurs."""
    model = FactorModel(_start(fixtures.ratings(spark, sf_dir)), RunConfig(num_features=WIDTH))
    tables = [spark.read.text(path).select(F.lit(side).alias("side"), F.col("value").alias("line"))
              for side, path in enumerate(model.export_text(_scratch(spark, "factors")))]
    return tables[0].unionByName(tables[1]).groupBy("side", "line").agg(F.count("*").alias("times"))


def _runs(spark) -> DataFrame:
    """A folder of configuration files, one a run, read as a table."""
    folder = Folder(spark, _scratch(spark, "runs"))
    for name, values in oracles.RUNS.items():
        lines = [f"{key} {value}" for key, value in {**oracles.RUN_COMMON, **values}.items()]
        folder.write(f"{name}.in", "\n".join(["# a run", *lines]) + "\n")
    return read_run_configs(spark, folder.path).withColumn("run", F.regexp_replace("run", r"\.in$", ""))


def _targets(spark) -> DataFrame:
    folder = Folder(spark, _scratch(spark, "targets"))
    folder.write("targets.txt", "".join(f"{name}   {goal}\n" for name, goal in oracles.RUN_TARGETS.items()))
    return read_targets(spark, folder.path)


def run_configs(spark, sf_dir):
    """Every run of the table with what it does an epoch on the training ratings."""
    size = _dims(fixtures.train(spark, sf_dir))
    records = F.lit(size.num_records).cast("long")
    values = F.lit(size.num_users + size.num_items).cast("long") * F.col("num_features")
    return _runs(spark).select(
        "run", *RunConfig().to_dict(), records.alias("num_records"),
        F.ceil(records / F.col("batch_size")).alias("batches"), values.alias("factor_values"))


def _traces(spark, sf_dir):
    targets = _targets(spark).withColumnRenamed("dataset", "run")
    engine = Engine(seed=SEED, shuffle="mix", init="mix", blocks=BLOCKS)
    return fit_runs(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir), _runs(spark).join(targets, "run", "left"), engine).traces


def run_traces(spark, sf_dir):
    """Errors of all runs, trained together; a run ends with the epoch that reaches its target."""
    return _traces(spark, sf_dir).select("run", "iter", F.round("test_rmse", 6).alias("test_rmse"))


def epochs_to_target(spark, sf_dir):
    """Train the table of runs on the training ratings and compare with the targets."""
    return metrics.epochs_to_target(_traces(spark, sf_dir).withColumnRenamed("run", "dataset"), _targets(spark))


# Preparation

def dims(spark, sf_dir):
    return profiles.dimensions(fixtures.ratings(spark, sf_dir))


def dedupe_last(spark, sf_dir):
    return profiles.dedupe_last(fixtures.ratings(spark, sf_dir))


def user_profiles(spark, sf_dir):
    maps = profiles.user_profiles(fixtures.ratings(spark, sf_dir))
    return maps.select("user_id", F.explode("profile").alias("item_id", "rating"))


def user_profile_text(spark, sf_dir):
    return profiles.profile_text(fixtures.ratings(spark, sf_dir))


def csr_offsets(spark, sf_dir):
    records = fixtures.ratings(spark, sf_dir)
    return ordering.user_offsets(records, _dims(records).num_users, SEED)


def shuffle_records(spark, sf_dir):
    return ordering.shuffled_positions(fixtures.ratings(spark, sf_dir), "rec_id", SEED).select("rec_id", "pos")


def shuffle_records_bijective(spark, sf_dir):
    """A permutation by arithmetic on the record number: nothing is sorted or shuffled."""
    return ordering.shuffled_positions(fixtures.ratings(spark, sf_dir), "rec_id", SEED, method="bijective").select("rec_id", "pos")


def shuffle_users(spark, sf_dir):
    users = spark.range(_dims(fixtures.ratings(spark, sf_dir)).num_users).select(
        F.col("id").cast("int").alias("user_id"))
    return ordering.shuffled_positions(users, "user_id", SEED)


def batch_sizes(spark, sf_dir):
    ordered = ordering.shuffled_positions(fixtures.ratings(spark, sf_dir), "rec_id", SEED)
    return ordering.batch_numbers(ordered, oracles.BATCH_SIZE).groupBy("batch").agg(
        F.count("*").alias("records"), F.sum("rating").alias("rating_sum"))


# Sequential descent

def _stratified(spark, sf_dir, rule, rate, precision="double", batch_size=1):
    train = fixtures.train(spark, sf_dir)
    ordered = ordering.shuffled_positions(train, "rec_id", SEED)
    ratings = strata.BlockedRatings.of(ordered, BLOCKS, precision)
    state = _start(train, oracles.SGD_WIDTH, precision, accumulators=rule == "adagrad")
    return strata.stratified_epoch(ratings, state, rule, oracles.SGD_WIDTH, rate, PENALTY, precision, batch_size).df


def sgd_epoch(spark, sf_dir):
    return _values(_stratified(spark, sf_dir, "sgd", SGD_RATE))


def adagrad_epoch(spark, sf_dir):
    return _values(_stratified(spark, sf_dir, "adagrad", ADAPTIVE_RATE))


def minibatch_block_epoch(spark, sf_dir):
    return _values(_stratified(spark, sf_dir, "minibatch", SGD_RATE, batch_size=16))


def sgd_half_epoch(spark, sf_dir):
    return _values(_stratified(spark, sf_dir, "sgd", SGD_RATE, "half"))


def adagrad_half_epoch(spark, sf_dir):
    return _values(_stratified(spark, sf_dir, "adagrad", ADAPTIVE_RATE, "half"))


def local_sgd_epoch(spark, sf_dir):
    train = fixtures.train(spark, sf_dir)
    ordered = ordering.shuffled_positions(train, "rec_id", SEED)
    ratings = PartedRatings.of(local_sgd.parts_by_record(ordered, RECORDS_PER_PART))
    return _values(local_sgd.local_epoch(ratings, _start(train, oracles.SGD_WIDTH), oracles.SGD_WIDTH,
                                         SGD_RATE, PENALTY).df)


def row_sgd_epoch(spark, sf_dir):
    train = fixtures.train(spark, sf_dir)
    deduped = profiles.dedupe_last(train)
    offsets = ordering.user_offsets(deduped, _dims(train).num_users, SEED)
    ratings = PartedRatings.of(local_sgd.parts_by_user(deduped, offsets, RECORDS_PER_PART, split_users=False))
    return _values(local_sgd.local_epoch(ratings, _start(train, oracles.SGD_WIDTH), oracles.SGD_WIDTH,
                                         SGD_RATE, PENALTY).df)


def train_trace(spark, sf_dir):
    config = RunConfig(gd_mode=2, num_features=oracles.SGD_WIDTH, learning_rate=ADAPTIVE_RATE,
                       regularization_factor=PENALTY, max_num_iterations=2, precision=2,
                       show_train_rmse=1, show_test_rmse=1)
    engine = Engine(seed=SEED, shuffle="mix", init="mix", blocks=BLOCKS)
    model = fit(fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir), config, engine)
    return model.metrics.select("iter", F.round("train_rmse", 6).alias("train_rmse"),
                                F.round("test_rmse", 6).alias("test_rmse"))


def train_resumed(spark, sf_dir):
    """The run of ``train_trace``, ended after one epoch and taken up again from its ledger."""
    path = _scratch(spark, "ledger")
    train, test = fixtures.train(spark, sf_dir), fixtures.test(spark, sf_dir)
    engine = Engine(seed=SEED, shuffle="mix", init="mix", blocks=BLOCKS)
    for epochs in (1, 2):
        config = RunConfig(gd_mode=2, num_features=oracles.SGD_WIDTH, learning_rate=ADAPTIVE_RATE,
                           regularization_factor=PENALTY, max_num_iterations=epochs, precision=2,
                           show_train_rmse=1, show_test_rmse=1)
        model = fit(train, test, config, engine, resume=path)
    return model.metrics.select("iter", F.round("train_rmse", 6).alias("train_rmse"),
                                F.round("test_rmse", 6).alias("test_rmse"))


def entry(spark: SparkSession) -> DataFrame:
    """Error of a freshly initialized model on the training ratings."""
    return train_rmse(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [scan_coo_text_one_based, predict_wide, predict_skewed, gd_epoch_wide, gd_epoch_grid_skewed, predict_trained,
              model_round_trip, factor_text_round_trip, scan_coo_text, scan_coo_binary, scan_coo_binary_wide, rebase_ids, init_factors, predict, residuals,
              quantize_half, export_factors, square_error_sum, train_rmse, test_rmse, user_gradients, item_gradients,
              gd_epoch, gd_epoch_grid, predict_grid,
              test_rmse_grid, minibatch_epoch, gd_trace, epochs_to_target, dims, dedupe_last, user_profiles,
              user_profile_text, csr_offsets, shuffle_records, shuffle_users, batch_sizes, sgd_epoch, adagrad_epoch,
              minibatch_block_epoch, sgd_half_epoch, adagrad_half_epoch, local_sgd_epoch, row_sgd_epoch, train_trace,
              train_resumed, run_configs, run_traces, gd_epoch_feature_sharded, shuffle_records_bijective,
              init_factors_parity, square_error_exact, scan_coo_binary_range]
    return {**{query.__name__: query for query in listed}, "check_ratings": check_ratings_query, **_corpus()[0]}


def oracle_sql() -> dict[str, str]:
    return {**oracles.statements(), **_corpus()[1]}


def _corpus() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the corpus operators, where that subpackage is installed."""
    try:
        import corpus_pipeline
        from ratingloom.llm import queries as corpus
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "ratingloom.llm"):
            raise
        return {}, {}
    statements = corpus.oracle_sql()
    if corpus_pipeline.ORACLE_SQL is not None:
        statements = {**statements, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {**corpus.queries(), "pipeline": corpus_pipeline.run}, statements
