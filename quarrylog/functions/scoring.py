"""The transparent 0-100 score, its severity, and the settings of both."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(name: str, value: object, low: int, high: int | None, text: str) -> None:
    if type(value) is not int or value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be {text}")


@dataclass(frozen=True)
class ScoringConfig:
    """Points for reaching a threshold, for the excess over it and for prevalence; severity cut-offs; longest text in a finding."""

    base_points: int = 50
    excess_points: int = 25
    prevalence_points: int = 25
    medium_cutoff: int = 60
    high_cutoff: int = 80
    max_finding_context: int = 240

    def __post_init__(self) -> None:
        for name in ("base_points", "excess_points", "prevalence_points"):
            _whole(name, getattr(self, name), 0, None, "a non-negative integer")
        for name in ("medium_cutoff", "high_cutoff"):
            _whole(name, getattr(self, name), 1, 100, "an integer between 1 and 100")
        _whole("max_finding_context", self.max_finding_context, 1, None, "a positive integer")
        if self.high_cutoff <= self.medium_cutoff:
            raise ValueError("medium_cutoff must be below high_cutoff")

    def to_dict(self) -> dict[str, int]:
        return asdict(self)


#: Least value of each threshold.
THRESHOLDS = {"error_threshold": 1, "repeat_threshold": 2, "burst_threshold": 2, "burst_window_seconds": 1}


@dataclass(frozen=True)
class SourceThresholds:
    """Thresholds of one source; None leaves the general one."""

    error_threshold: int | None = None
    repeat_threshold: int | None = None
    burst_threshold: int | None = None
    burst_window_seconds: int | None = None

    def __post_init__(self) -> None:
        for name, least in THRESHOLDS.items():
            if getattr(self, name) is not None:
                _whole(name, getattr(self, name), least, None, f"an integer >= {least}")

    def to_dict(self) -> dict[str, int]:
        return {k: v for k, v in asdict(self).items() if v is not None}


def score(count: Column, threshold: Column, total: Column, scoring: ScoringConfig) -> Column:
    """bround: halves go to the even number, as in the definition of the score."""
    excess = F.bround(scoring.excess_points * F.greatest(F.lit(0), count - threshold) / threshold)
    prevalence = F.bround(scoring.prevalence_points * count / total)
    points = F.lit(scoring.base_points) + F.least(F.lit(scoring.excess_points), excess) + F.least(F.lit(scoring.prevalence_points), prevalence)
    return F.when(total < 1, 0).otherwise(F.least(F.lit(100), points)).cast("int")


def severity(points: Column, scoring: ScoringConfig) -> Column:
    return F.when(points >= scoring.high_cutoff, "high").when(points >= scoring.medium_cutoff, "medium").otherwise("low")
