"""Rating-matrix factorization on Spark."""

from ratingloom.config import RunConfig
from ratingloom.model import FactorModel
from ratingloom.plans.runs import fit_runs
from ratingloom.plans.training import Engine, fit
from ratingloom.sources.ratings import RatingSet, check_ratings, read_ratings
from ratingloom.sources.run_config import read_run_config, read_run_configs, read_targets

__all__ = ["Engine", "FactorModel", "RatingSet", "RunConfig", "check_ratings", "fit", "fit_runs",
           "read_ratings", "read_run_config", "read_run_configs", "read_targets"]
