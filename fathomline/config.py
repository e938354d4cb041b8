"""Settings of the panels, lanes and validators. Invariants are checked when a setting is made."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from typing import Any

#: The windows, in weeks, that panels have.
WINDOWS = (4, 8, 13, 26, 52)


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def _shares(**values: float) -> None:
    for name, value in values.items():
        _check(0 <= value <= 1, f"{name} must lie in [0, 1]")


def _above(**values: float) -> None:
    for name, value in values.items():
        _check(0 < value <= 1, f"{name} must lie in (0, 1]")


@dataclass(frozen=True)
class PanelConfig:
    #: Names and defaults of this and the following settings are those that callers know.
    benchmark_security: str = "SPY"
    min_participation: float = 0.50
    min_value: float = 0.0
    m0_window: int = 26
    min_history_weeks: int = 52

    def __post_init__(self) -> None:
        _check(bool(self.benchmark_security.strip()), "benchmark_security must not be empty")
        _above(min_participation=self.min_participation)
        _check(math.isfinite(self.min_value) and self.min_value >= 0, "min_value must be finite and not negative")
        _check(self.m0_window in WINDOWS, f"m0_window must be one of {WINDOWS}")
        _check(self.min_history_weeks >= 1, "min_history_weeks must be positive")

    @property
    def benchmark(self) -> str:
        return self.benchmark_security.strip().upper()

    @property
    def panel(self) -> PanelConfig:
        """What a panel and its metrics hang on; settings that share it share their tables."""
        return PanelConfig(self.benchmark, float(self.min_participation), float(self.min_value), self.m0_window)


@dataclass(frozen=True)
class CurrentLeaderConfig(PanelConfig):
    min_breadth: float = 0.50
    min_relative_strength: float = 0.0
    min_score: float = 0.60
    leader_count: int = 1
    score_weights: tuple[float, float, float, float] = (0.30, 0.35, 0.20, 0.15)

    def __post_init__(self) -> None:
        super().__post_init__()
        _shares(min_breadth=self.min_breadth)
        _check(self.leader_count >= 1, "leader_count must be positive")
        _check(len(self.score_weights) == 4 and abs(sum(self.score_weights) - 1) < 1e-9, "score_weights must be four numbers that sum to 1")


@dataclass(frozen=True)
class EmergingRadarConfig(PanelConfig):
    min_history_weeks: int = 26
    min_acceleration_rank: float = 0.60
    min_rank_improvement: float = 0.05
    min_fast_breadth: float = 0.35
    min_participation_for_watch: float = 0.50
    max_concentration: float = 0.65
    min_fast_relative_strength: float = -0.02
    score_threshold: float = 0.55

    def __post_init__(self) -> None:
        super().__post_init__()
        _shares(
            min_acceleration_rank=self.min_acceleration_rank,
            min_fast_breadth=self.min_fast_breadth,
            min_participation_for_watch=self.min_participation_for_watch,
            max_concentration=self.max_concentration,
        )


@dataclass(frozen=True)
class HoldCandidateConfig(PanelConfig):
    min_relative_strength: float = 0.0
    min_breadth: float = 0.50
    min_durability_score: float = 0.60
    min_confirmed_weeks: int = 2
    confirmation_window: int = 3
    max_concentration: float = 0.65
    max_annualized_volatility: float = 0.65
    max_drawdown: float = 0.45
    min_score: float = 0.60

    def __post_init__(self) -> None:
        super().__post_init__()
        _shares(min_breadth=self.min_breadth, min_durability_score=self.min_durability_score, max_concentration=self.max_concentration)
        _above(max_drawdown=self.max_drawdown)
        _check(1 <= self.min_confirmed_weeks <= self.confirmation_window, "min_confirmed_weeks must lie in 1..confirmation_window")
        _check(self.max_annualized_volatility > 0, "max_annualized_volatility must be positive")


@dataclass(frozen=True)
class AnnualConfig:
    benchmark_security: str = "SPY"
    min_participation: float = 0.50
    min_weeks_per_year: int = 26
    min_coverage: float = 0.70
    top_n: int = 3
    signal_history_weeks: int = 26
    early_min_rank: float = 0.70
    early_min_acceleration_rank: float = 0.70
    early_min_rank_improvement: float = 0.10
    early_min_breadth: float = 0.50
    early_min_participation: float = 0.50
    early_min_fast_rs: float = 0.0
    early_min_m0: float = -0.30
    confirmation_count: int = 2
    confirmation_window_weeks: int = 3

    def __post_init__(self) -> None:
        _check(bool(self.benchmark_security.strip()), "benchmark_security must not be empty")
        _above(min_participation=self.min_participation, min_coverage=self.min_coverage)
        _shares(early_min_rank=self.early_min_rank, early_min_acceleration_rank=self.early_min_acceleration_rank, early_min_breadth=self.early_min_breadth, early_min_participation=self.early_min_participation)
        _check(self.signal_history_weeks >= 1, "signal_history_weeks must be positive")
        _check(self.top_n >= 1 and self.min_weeks_per_year >= 1, "top_n and min_weeks_per_year must be positive")
        _check(1 <= self.confirmation_count <= self.confirmation_window_weeks, "confirmation_count must lie in 1..confirmation_window_weeks")

    @property
    def panel(self) -> PanelConfig:
        return PanelConfig(self.benchmark_security, self.min_participation, min_history_weeks=self.signal_history_weeks)


#: For each field of EpisodeConfig the section of an episode file that may hold it and its names there, the first that is there counts. A field outside its section counts too.
EPISODE_KEYS = {
    "horizon_weeks": ("major_surge", ["horizon_weeks"]),
    "major_return": ("major_surge", ["min_theme_gain", "major_return"]),
    "major_excess": ("major_surge", ["min_spy_excess", "major_excess"]),
    "explosive_return": ("explosive", ["min_theme_gain", "explosive_return"]),
    "min_breadth": ("major_surge", ["min_breadth_up", "min_breadth"]),
    "min_beat_breadth": ("major_surge", ["min_breadth_beat_spy"]),
    "min_names": ("major_surge", ["min_valid_names", "min_names"]),
    "onset_weeks": ("onset", ["lookback_weeks"]),
    "merge_gap_weeks": ("onset", ["merge_gap_weeks"]),
    "min_rank": ("major_surge", ["min_theme_rank_percentile", "min_theme_rank"]),
}
#: The names of those fields in to_mapping().
EPISODE_NAMES = {"min_beat_breadth": "min_breadth_beat_spy", "onset_weeks": "onset_lookback_weeks", "min_rank": "min_theme_rank"}


@dataclass(frozen=True)
class EpisodeConfig:
    """Returns are shares: 0.8 is 80 %; 80 is not read as a percentage."""

    major_return: float = 0.80
    major_excess: float = 0.40
    explosive_return: float = 1.00
    min_breadth: float = 0.60
    min_beat_breadth: float = 0.50
    min_names: int = 4
    horizon_weeks: int = 52
    onset_weeks: int = 26
    merge_gap_weeks: int = 13
    min_rank: float = 0.90
    require_breadth: bool = True
    next_session: bool = True
    max_forward: bool = True
    require_min_names: bool = True
    #: Kept with the other settings; no label hangs on it.
    max_move_before_signal: float | None = None

    def __post_init__(self) -> None:
        _shares(min_breadth=self.min_breadth, min_beat_breadth=self.min_beat_breadth, min_rank=self.min_rank)
        moves = [self.major_return, self.major_excess, self.explosive_return, *([] if self.max_move_before_signal is None else [self.max_move_before_signal])]
        _check(all(math.isfinite(x) for x in moves), "returns must be finite")
        _check(min(self.horizon_weeks, self.onset_weeks) >= 1, "horizon_weeks and onset_weeks must be positive")
        _check(self.merge_gap_weeks >= 0 and self.min_names >= 0, "merge_gap_weeks and min_names must not be negative")

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> EpisodeConfig:
        """From the nested mapping of an episode file, or from what to_mapping() gives."""
        own = {}
        for field, (section, names) in EPISODE_KEYS.items():
            kind = type(getattr(cls, field))
            places = [(values.get(section) or {}, names), (values, [field, EPISODE_NAMES.get(field, field), *(n for n in names if section == "major_surge")])]
            found = [place[n] for place, keys in places for n in keys if n in place]
            if found:
                own[field] = kind(found[0])
        return cls(**own)

    def to_mapping(self) -> dict[str, Any]:
        return {EPISODE_NAMES.get(field, field): getattr(self, field) for field in EPISODE_KEYS}


@dataclass(frozen=True)
class EarlyHitConfig:
    """persistence_window None: as many decisions as persistence_count. log_fraction None: no limit on the share of the move already made."""

    horizon_weeks: int = 52
    weeks_before: int = 4
    weeks_after: int = 8
    log_fraction: float | None = 0.25
    persistence_count: int = 2
    persistence_window: int | None = 3
    next_session: bool = True

    def __post_init__(self) -> None:
        _check(self.persistence_count >= 1, "persistence_count must be positive")
        _check(self.persistence_window is None or self.persistence_count <= self.persistence_window, "persistence_window must not be less than persistence_count")
        _check(self.horizon_weeks >= 1 and min(self.weeks_before, self.weeks_after) >= 0, "horizon_weeks must be positive, the weeks of the window not negative")
        _check(self.log_fraction is None or math.isfinite(self.log_fraction), "log_fraction must be finite")

    @property
    def window(self) -> int:
        return self.persistence_window or self.persistence_count


@dataclass(frozen=True)
class SplitConfig:
    n_splits: int = 5
    test_size: int | None = None
    train_size: int | None = None
    embargo: int = 4
    min_train_size: int = 1

    def __post_init__(self) -> None:
        _check(self.n_splits >= 1 and self.embargo >= 0 and self.min_train_size >= 1, "n_splits and min_train_size must be positive, embargo not negative")


@dataclass(frozen=True)
class Clock:
    """The day that freshness is measured against."""

    today: date
