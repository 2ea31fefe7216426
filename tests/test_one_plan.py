"""Factor tables are never broadcast: Spark takes an array for one value and underrates them."""

from pyspark.sql import functions as F

from ratingloom.operators import factors, metrics
from ratingloom.plans import feature_shards

WIDTH = 6


def _ratings(spark):
    return spark.range(300).select(
        F.col("id").alias("rec_id"), (F.col("id") % 7).cast("int").alias("user_id"),
        (F.col("id") % 11).cast("int").alias("item_id"), (1.0 + F.col("id") % 5).alias("rating"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_are_not_broadcast(spark):
    slices = feature_shards.sliced(factors.init_state(spark, 7, 11, WIDTH), 4)
    done = feature_shards.sharded_epoch(_ratings(spark), slices, 4, 0.02, 0.05)
    assert "Broadcast" not in _plan(done)
    assert done.count() == slices.count()


def test_scores_have_one_plan_without_sorts(spark):
    state = factors.init_state(spark, 7, 11, WIDTH)
    plan = _plan(metrics.square_error(_ratings(spark), state))
    assert "Broadcast" not in plan and "Sort" not in plan and plan.count("ShuffledHashJoin") == 2
    stepped = factors.apply_step(state, state.withColumnRenamed("features", "gradient"), 0.02, 0.05)
    assert "Broadcast" not in _plan(stepped)
