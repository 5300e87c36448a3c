"""Default ladders, windows and thresholds; every comparison with them is strict as the operators state it."""

from __future__ import annotations

from dataclasses import dataclass

#: The version, ladders, windows and thresholds of the methodology.
METHODOLOGY_VERSION = "1.0.8-draft"


@dataclass(frozen=True)
class Params:
    market_deltas: tuple[str, ...] = ("0.02", "0.05", "0.10")
    manipulation_deltas: tuple[str, ...] = ("0.5", "1", "10", "100")
    liquidation_delta: str = "0.10"
    liquidation_haircut: str = "0.5"
    critical_delta: str = "0.5"
    manipulation_margin: str = "0.25"
    oracle_window_seconds: int = 900
    book_comparison_seconds: int = 900
    manipulation_cheap: int = 10_000
    manipulation_ratio_low_pct: str = "0.1"
    thin_depth: int = 50_000
    spread_pct: int = 20
    divergence_pct: int = 10
    top1_pct: int = 50
    top10_pct: int = 80
    wash_pct: int = 50
    stale_days: int = 30
    stale_warn_days: int = 7
    dust: str = "0.01"
    outlier_factor: float = 1.5


DEFAULT = Params()
