"""Options of an analysis, and the fixed thresholds of its decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

# They decide which columns are kept and how they are encoded.
HIGH_CARDINALITY = 20
LOW_VARIANCE_DISTINCT = 1
DATETIME_SHARE = 0.85
ID_NAME_HINTS = ("unnamed:", "id", "index", "rowid", "row_id", "row_num", "_id")
SKEW_ADVICE = 1.5
SKEW_FINDING = 2.0
LEAKAGE_CORRELATION = 0.99
DEGENERATE_STD = 1e-9
PERFECT_R2 = 0.9999
OVERFIT_SUMMARY_GAP = 0.15
OVERFIT_AUDIT_GAP = 0.20
MISSING_PERCENT = 5.0
HISTOGRAM_BINS = 40
TOP_FEATURES = 20
PREVIEW_ROWS = 10
FOLD_SEED = 42


@dataclass(frozen=True)
class Options:
    target: str
    selected_models: tuple[str, ...] | None = None
    test_size: float = 0.2
    random_state: int = 42
    cv_folds: int = 5
    cv_strategy: str = "kfold"  # kfold, time or group
    split_strategy: str = "random"  # random or time
    time_column: str | None = None
    group_column: str | None = None
    log_transform_target: bool = False
    auto_datetime_features: bool = True
    drop_low_variance: bool = True
    auto_drop_id_columns: bool = True
    tune_hyperparameters: bool = False
    #: Drop a group column that looks like an id, as older behaviour did; it is protected otherwise.
    strict_compat: bool = False
    progress: Callable[[str, str], None] | None = field(default=None, compare=False)
    #: Estimators by name, in place of the default ones.
    models: dict[str, Any] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.cv_strategy not in ("kfold", "time", "group"):
            raise ValueError(f"cv_strategy must be kfold, time or group, not {self.cv_strategy!r}")
        if self.split_strategy not in ("random", "time"):
            raise ValueError(f"split_strategy must be random or time, not {self.split_strategy!r}")
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must be between 0 and 1")
        if self.cv_folds < 2:
            raise ValueError("cv_folds must be at least 2")

    @classmethod
    def from_controls(cls, target: str, time_aware: bool = False, group_column: str | None = None, time_column: str | None = None, **more: Any) -> Options:
        """Options as a form gives them: a group column decides for group folds, else a time-aware run
        for time folds and a time split; "(none)" is no column."""
        none = lambda c: None if c in (None, "", "(none)") else c
        group, when = none(group_column), none(time_column)
        strategy = "group" if group else "time" if time_aware else "kfold"
        return cls(target, cv_strategy=strategy, split_strategy="time" if time_aware else "random", time_column=when, group_column=group, **more)

    def report(self, stage: str, message: str) -> None:
        if self.progress:
            self.progress(stage, message)
