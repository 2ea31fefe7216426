"""Batch and mini-batch gradient descent as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.factors import RatingSkew, apply_step
from ratingloom.operators.gradients import gradient_sums
from ratingloom.plans import grid, streamed
from ratingloom.session import StagedTable, stage

# A job each: more batches than this per epoch are refused.
MAX_DATAFRAME_BATCHES = 64


def gd_epoch(ratings: DataFrame, state: DataFrame, width: int, learning_rate: float, regularization: float,
             precision: str = "double", skew: RatingSkew | None = None, carry: tuple[str, ...] = (),
             made: list[StagedTable] | None = None) -> DataFrame:
    """One step over all records: every touched row moves once by its summed gradient.

    Wide rows meet the ratings on a grid, or are streamed if they are many, where that moves less than a factor
    array per rating. ``carry`` may name ``square`` and ``rated``, see ``gradient_sums``.
    What was written on the way is added to ``made``, to be dropped when the result was used.
    """
    found = grid.wide_pass(ratings, state, width)
    if isinstance(found, streamed.Sizes):
        store = streamed.StreamedRows.of(state, width)
        if made is not None:
            made.extend(store.tables.values())
        moved = streamed.epoch(ratings, store, found.records, learning_rate, regularization, precision)
        return moved.select("side", "id", "features", *carry)
    gradients = grid.grid_gradients(found, state, width) if found else gradient_sums(ratings, state, width, skew)
    return apply_step(state, gradients, learning_rate, regularization, precision, carry)


def minibatch_epoch(batched: DataFrame, num_batches: int, state: DataFrame, width: int, learning_rate: float,
                    regularization: float, precision: str = "double",
                    skew: RatingSkew | None = None, root: str | None = None) -> StagedTable:
    """One epoch of exact global mini-batches, in batch order.

    ``batched`` has a ``batch`` column and should be stored partitioned by it, so that each
    step scans only its own files. Each batch needs the result of the one before, and a plan
    that nests them would triple with every step: the state is written between batches.
    """
    if num_batches > MAX_DATAFRAME_BATCHES:
        raise ValueError(f"{num_batches} batches per epoch; use blockwise batches beyond {MAX_DATAFRAME_BATCHES}")
    current: StagedTable | None = None
    for number in range(num_batches):
        records = batched.where(F.col("batch") == number)
        before = current.df if current else state
        made: list[StagedTable] = []
        following = stage(gd_epoch(records, before, width, learning_rate, regularization, precision, skew, made=made),
                          "minibatch-state", root=root)
        for table in made:
            table.drop()
        if current:
            current.drop()
        current = following
    return current if current else stage(state, "minibatch-state", root=root)
