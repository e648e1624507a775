"""Parameters of a motif scan, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass

LEVELS = ("high", "low")


@dataclass(frozen=True)
class ScanConfig:
    min_mer: int = 5
    max_mer: int = 32
    low_baseline: float = 0.5
    high_baseline: float = 0.8
    slice_length: int = 150

    def __post_init__(self) -> None:
        if not 3 <= self.min_mer <= self.max_mer <= 64:
            raise ValueError("3 <= min_mer <= max_mer <= 64 is required")
        if not 0 < self.low_baseline <= self.high_baseline <= 1:
            raise ValueError("0 < low_baseline <= high_baseline <= 1 is required")
        if self.slice_length < 2 * self.max_mer:
            raise ValueError("slice_length must be at least 2 * max_mer")

    @property
    def baselines(self) -> dict[str, float]:
        return {"high": self.high_baseline, "low": self.low_baseline}
