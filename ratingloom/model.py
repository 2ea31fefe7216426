"""A trained model: two factor tables with prediction, evaluation and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.config import RunConfig
from ratingloom.operators.factors import ITEM, USER, predict, side_of
from ratingloom.operators.metrics import square_error
from ratingloom.plans import grid
from ratingloom.session import task_slots
from ratingloom.sources.factor_text import write_factor_text


class FactorModel:
    """``state`` is ``(side, id, features[, acc])``; ``metrics`` has one row per epoch.

    ``plan`` names the epoch that ran; ``layout`` tells the blocks of stratified descent and
    whether frequent rows were split into averaged copies.
    """

    def __init__(self, state: DataFrame, config: RunConfig, metrics: DataFrame | None = None,
                 plan: str | None = None, layout: str = ""):
        self.state = state
        self.config = config
        self.metrics = metrics
        self.plan = plan or config.method
        self.layout = layout

    @property
    def user_factors(self) -> DataFrame:
        return side_of(self.state, USER)

    @property
    def item_factors(self) -> DataFrame:
        return side_of(self.state, ITEM)

    def predict(self, ratings: DataFrame, cold_start: str = "drop") -> DataFrame:
        """Add ``prediction`` (and ``residual`` where ``rating`` is known). Needs a ``rec_id`` column."""
        return predict(ratings, self.state, cold_start=cold_start)

    def predict_on_grid(self, ratings: DataFrame, blocks: int | None = None) -> DataFrame:
        """The same scores for large rated sets: factor rows travel once per grid cell, not once per rating.

        Returns ``(rec_id, user_id, item_id, rating, prediction, residual)`` and drops unknown ids.
        """
        cells = grid.grid_ratings(ratings, blocks or self._blocks(ratings.count()), self.config.storage)
        return grid.grid_predict(cells, self.state, self.config.num_features)

    def evaluate(self, ratings: DataFrame) -> DataFrame:
        """``(square_error_sum, num_records, rmse, num_dropped)``; dropped are ids the model lacks.

        Runs on a grid or by joins, whichever moves less data.
        """
        total = ratings.count()
        blocks = self._blocks(total)
        if grid.pays_off(total, self.state.count(), self.config.num_features, blocks):
            cells = grid.grid_ratings(ratings, blocks, self.config.storage)
            errors = grid.grid_square_error(cells, self.state, self.config.num_features)
        else:
            errors = square_error(ratings, self.state)
        return errors.withColumn("num_dropped", F.lit(total) - F.col("num_records"))

    def _blocks(self, num_records: int) -> int:
        return grid.grid_size(num_records, self.state.count(), self.config.num_features,
                              task_slots(self.state.sparkSession))

    def save(self, path: str) -> None:
        """Write both factor tables as parquet, users and items apart."""
        self.user_factors.write.parquet(f"{path}/users")
        self.item_factors.write.parquet(f"{path}/items")
        spark = self.state.sparkSession
        spark.createDataFrame([self.config.to_dict()]).coalesce(1).write.json(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FactorModel:
        sides = [spark.read.parquet(f"{path}/{name}").withColumn("side", F.lit(side))
                 for side, name in ((USER, "users"), (ITEM, "items"))]
        config = RunConfig.from_row(spark.read.json(f"{path}/config").first())
        lists = [c for c in sides[0].columns if c not in ("side", "id")]
        state = sides[0].unionByName(sides[1]).select("side", "id", *lists)
        return cls(state, config)

    def export_text(self, folder: str, single: bool = False) -> tuple[str, str]:
        """Write both factor tables as text, users first, each as a folder or a ``single`` file; returns the two paths."""
        return (write_factor_text(self.user_factors, folder, "user", single=single),
                write_factor_text(self.item_factors, folder, "item", single=single))
