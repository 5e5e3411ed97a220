"""Tunables of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are the documented thresholds; pass another instance to change them."""

    checksum_validation: bool = True
    max_findings: int = 500
    fan_threshold: int = 5
    fan_high: int = 10
    velocity_days: int = 7
    velocity_threshold: int = 15
    velocity_high: int = 30
    recurring_spread: float = 0.2
    spike_factor: float = 5.0
    spike_rows: int = 30
    dormant_days: float = 30.0
    max_hops: int = 5
    page_rank_damping: float = 0.85
    page_rank_iterations: int = 100
    page_rank_tolerance: float = 1e-6
    label_iterations: int = 10


DEFAULT = EngineConfig()
