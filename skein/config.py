"""Settings of the series operators."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class IntervalConfig:
    bins: int = 24
    cadence: float = 0.15
    step_clip: int = 12
    duration_bins: int = 8
    min_voiced_ratio: float = 0.30
    min_voiced: int = 6
    min_harmonic_ratio: float = 0.55
    energy_quantile: float = 0.2
    min_run: int = 3
    segment_length: int = 20
    segments: int = 4

    def __post_init__(self) -> None:
        if self.bins < 2 or self.segments < 1 or self.segment_length < 1 or not 0 < self.cadence <= 1 or self.duration_bins < 1 or self.step_clip < 0:
            raise ValueError(f"impossible settings: {self}")

    @property
    def segment_size(self) -> int:
        """Values of a segment's vector: histogram, transitions, cadence, steps, durations, 8 scalars."""
        return self.bins * self.bins + 2 * self.bins + 2 * self.step_clip + 1 + self.duration_bins + 8

    @property
    def track_size(self) -> int:
        return self.segment_size + 3

    def signature(self) -> str:
        return ",".join(f"{k}={v}" for k, v in sorted(asdict(self).items()))


@dataclass(frozen=True)
class ModeConfig:
    """Settings of the absolute variant; fewer than 12 bins become 12."""

    bins: int = 24
    cadence: float = 0.10
    min_voiced: int = 4

    def __post_init__(self) -> None:
        object.__setattr__(self, "bins", max(12, self.bins))


@dataclass(frozen=True)
class SplitConfig:
    val: float = 0.15
    test: float = 0.15
    seed: int = 42

    def __post_init__(self) -> None:
        if not (0 < self.val < 1 and 0 <= self.test < 1 and self.val + self.test < 1):
            raise ValueError("the shares of val and test must leave a train split")
