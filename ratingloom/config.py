"""Run configuration: the parameters of one training run."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

# Fixed values of the configuration keys.
BATCH_GD, MINI_BATCH_SGD, ADAPTIVE_SGD = 0, 1, 2
BY_RECORD, BY_ROW, BY_FEATURE = 0, 1, 2
PRECISIONS = {0: "half", 1: "single", 2: "double"}


@dataclass(frozen=True)
class RunConfig:
    gd_mode: int = ADAPTIVE_SGD
    batch_size: int = 1
    num_features: int = 128
    learning_rate: float = 0.1
    regularization_factor: float = 0.05
    max_num_iterations: int = 70
    decomp_mode: int = BY_FEATURE
    lock: int = 0
    precision: int = 0
    show_train_rmse: int = 0
    show_test_rmse: int = 0

    def __post_init__(self):
        allowed = {"gd_mode": (0, 1, 2), "decomp_mode": (0, 1, 2), "lock": (0, 1), "precision": tuple(PRECISIONS),
                   "show_train_rmse": (0, 1), "show_test_rmse": (0, 1)}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}, not {getattr(self, name)!r}")
        for name, least in (("batch_size", 1), ("num_features", 1), ("max_num_iterations", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")

    @classmethod
    def from_row(cls, row) -> RunConfig:
        """Build from a row of the run table (see ``sources.run_config``); other columns are ignored."""
        values = row.asDict() if hasattr(row, "asDict") else dict(row)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

    def to_dict(self) -> dict:
        return asdict(self)

    @property
    def storage(self) -> str:
        return PRECISIONS[self.precision]

    @property
    def method(self) -> str:
        """Which epoch the parameters select."""
        if self.gd_mode == BATCH_GD:
            return "gd"
        if self.gd_mode == ADAPTIVE_SGD:
            return "adagrad"
        if self.batch_size > 1:
            return "minibatch"
        if self.decomp_mode == BY_ROW:
            return "row_sgd"
        if self.decomp_mode == BY_RECORD and not self.lock:
            return "local_sgd"
        return "sgd"
