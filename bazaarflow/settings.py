"""Thresholds used across the jobs. Plain dataclasses; every job takes them as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class QualitySettings:
    start_date: date = date(2024, 7, 1)
    end_date: date = date(2026, 7, 20)
    maximum_price: float = 250_000.0
    stale_after_days: int = 7
    long_gap_days: int = 30
    minimum_records: int = 90
    minimum_weekly_coverage: float = 0.35
    high_weekly_coverage: float = 0.75
    maximum_age_days: int = 21
    coverage_window_days: int = 730
    history_days: int = 760
    series_per_group: int = 3


@dataclass(frozen=True)
class ModelSettings:
    horizon_days: int = 7
    maximum_lead_days: int = 28
    minimum_reports: int = 9
    seed: int = 42
    interval_coverage: float = 0.80
    fold_days: int = 60
    folds: int = 3
    holdout_days: int = 60
    minimum_training_rows: int = 500
    minimum_improvement: float = 0.01
    minimum_fold_win_share: float = 0.666
    bootstrap_repetitions: int = 2000
    # gradient-boosted trees
    learning_rate: float = 0.05
    trees: int = 260
    minimum_leaf_rows: int = 35
    # smallest calibration sample per interval level
    interval_minimum_samples: dict = field(
        default_factory=lambda: {"market": 40, "state_crop": 35, "crop": 50, "lead": 100}
    )


@dataclass(frozen=True)
class Settings:
    quality: QualitySettings = QualitySettings()
    model: ModelSettings = field(default_factory=ModelSettings)


DEFAULTS = Settings()
