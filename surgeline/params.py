"""Every constant of the thrust detectors and studies, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ThrustParams:
    """The canonical thresholds for a universe of about 500 names."""

    ma_window: int = 50
    high_low_window: int = 252
    zweig_span: int = 10
    zweig_low: float = 0.40
    zweig_high: float = 0.615
    deemer_window: int = 10
    deemer_ratio: float = 1.90
    mcc_fast: int = 19
    mcc_slow: int = 39
    mcc_floor: float = -50.0
    mcc_window: int = 20
    pct_low: float = 0.25
    pct_high: float = 0.75
    pct_window: int = 15
    ratio_low: float = 0.10
    ratio_high: float = 0.50
    ratio_window: int = 10
    net_highs: float = 20.0
    net_window: int = 10
    up_volume: float = 0.90
    up_volume_window: int = 5
    memory: int = 60
    min_valid: int = 400
    scale: float = 1.0
    weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)


#: Sessions of each study horizon.
HORIZONS = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "12m": 252}
THRESHOLDS = (1, 2, 3, 4)

#: Relaxed thresholds under which every branch of the detectors fires on the derived panel.
RELAXED = ThrustParams(
    zweig_low=0.46, zweig_high=0.54, deemer_ratio=1.2, mcc_floor=-0.5, pct_low=0.30, pct_high=0.44,
    net_highs=1.0, up_volume=0.72, memory=15, min_valid=20,
)


@dataclass(frozen=True)
class TiltParams:
    base: float = 0.60
    deltas: tuple[float, ...] = (0.10, 0.20, 0.30)
    holds: tuple[int, ...] = (10, 21, 42)
    cost_bps: float = 10.0
    year: int = 252
    min_trade: float = 1e-4
    variants: tuple[str, ...] = field(default=("V1", "V2"))
