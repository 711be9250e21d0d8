"""Limits of the boundary policy and of scoring windows; a set of limits that contradicts itself is refused when it is made."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Policy:
    """Gaps in milliseconds end the bands normal, medium and large; a join needs a probability below the band's limit."""

    normal_gap_ms: int = 500
    medium_gap_ms: int = 1_500
    extreme_gap_ms: int = 30_000
    normal_join_max: float = 0.50
    medium_join_max: float = 0.20
    large_join_max: float = 0.05
    override_max: float = 0.95
    min_score: int = 3
    dash_penalty: int = 2

    def __post_init__(self) -> None:
        for f in fields(self):
            value, whole = getattr(self, f.name), f.type == "int"
            if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
                raise ValueError(f"{f.name} must be {'an integer' if whole else 'a number'}")
            if value < 0 or not math.isfinite(value) or (not whole and value > 1):
                raise ValueError(f"{f.name} is out of range")
        if not self.normal_gap_ms <= self.medium_gap_ms < self.extreme_gap_ms:
            raise ValueError("gap limits must rise: normal <= medium < extreme")
        if not self.normal_join_max >= self.medium_join_max >= self.large_join_max:
            raise ValueError("join limits must not rise as gaps grow")
        if self.min_score < 1:
            raise ValueError("min_score must be 1 or more")


@dataclass(frozen=True)
class Windows:
    """Scoring windows of `size` cues; each owns the boundaries that lie `context` cues or more inside it."""

    size: int = 48
    context: int = 6

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{f.name} must be a positive integer")
        if self.size < 2 * self.context + 2:
            raise ValueError("size must be at least 2 * context + 2")

    @property
    def hop(self) -> int:
        return self.size - 2 * self.context


DEFAULT = Policy()
