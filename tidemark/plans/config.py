"""Settings of all layers, with their defaults and range checks."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class StructureConfig:
    internal: int = 3
    external: int = 8
    atr_period: int = 14
    displacement_atr: float = 1.0
    need_displacement: bool = True
    equal_atr: float = 0.10

    def __post_init__(self):
        _check(self.internal > 0 and self.external > 0, "swing lengths must be positive")
        _check(self.equal_atr >= 0, "equal_atr must not be negative")


@dataclass(frozen=True)
class ZoneConfig:
    swing: int = 3
    base_left: int = 2
    base_right: int = 1
    departure_ahead: int = 5
    body_atr: float = 0.45
    range_atr: float = 0.75
    close_share: float = 0.60
    base_range_atr: float = 1.20
    use_last_opposing: bool = True
    width_atr: tuple[float, float] = (0.03, 1.50)
    max_width_pips: float = 10.0
    stop_buffer_atr: float = 0.03
    stop_buffer_pips: float = 0.5
    max_stop_pips: float = 10.0
    max_retests: int = 1
    invalidation: str = "close"
    penetration_atr: float = 0.05
    max_age: int = 60
    spacing: int = 8
    nearest: bool = True
    atr_period: int = 14

    def __post_init__(self):
        _check(self.invalidation in ("close", "wick"), "invalidation must be close or wick")
        _check(self.max_age >= 0 and self.spacing >= 0, "ages must not be negative")


#: Sessions as (name, first hour, hour after the last), tried in this order (fixed values).
SESSIONS = (("Asia", 0, 8), ("London", 8, 13), ("NewYork", 13, 22))


@dataclass(frozen=True)
class SessionConfig:
    sessions: tuple[tuple[str, int, int], ...] = SESSIONS
    sweep_bars: int = 24
    close_back: bool = True
    wick_sweeps: bool = True

    def __post_init__(self):
        _check(self.sweep_bars >= 0, "sweep_bars must not be negative")
        _check(all(0 <= a < b <= 24 for _, a, b in self.sessions), "session hours must lie in a day")


@dataclass(frozen=True)
class ProfileConfig:
    sessions: tuple[tuple[str, int, int], ...] = SESSIONS
    decimals: int = 5
    tolerance: float = 0.00020

    def __post_init__(self):
        _check(self.tolerance >= 0 and self.decimals >= 0, "profile settings must not be negative")


@dataclass(frozen=True)
class GapConfig:
    min_gap: float = 0.0
    fill_tolerance: float = 0.0
    max_age: int = 120
    only_latest: bool = False
    tolerance: float = 0.0
    relevance_atr: float = 0.10

    def __post_init__(self):
        _check(self.max_age >= 1 and self.min_gap >= 0, "gap settings out of range")


@dataclass(frozen=True)
class RetracementConfig:
    min_leg: float = 0.0
    tolerance: float = 0.0

    def __post_init__(self):
        _check(self.min_leg >= 0 and self.tolerance >= 0, "retracement settings must not be negative")


@dataclass(frozen=True)
class PoolConfig:
    tolerance: float = 0.00015
    sweep_bars: int = 20
    two_touches: bool = False
    proximity_atr: float = 0.50

    def __post_init__(self):
        _check(self.tolerance >= 0 and self.sweep_bars >= 0, "pool settings must not be negative")


@dataclass(frozen=True)
class LevelConfig:
    pivot: int = 3
    cluster_atr: float = 0.35
    recency: int = 250
    min_touches: int = 1
    runner_rr: tuple[float, float] = (2.3, 4.0)
    buffer_atr: float = 0.05

    def __post_init__(self):
        _check(self.pivot > 0 and self.recency > 0, "level settings out of range")


@dataclass(frozen=True)
class FeatureConfig:
    """All layers; a layer that is switched off leaves default columns."""

    atr_period: int = 14
    atr_method: str = "rma"
    pip: float = 0.0001
    structure: StructureConfig = field(default_factory=StructureConfig)
    zones: ZoneConfig = field(default_factory=ZoneConfig)
    sessions: SessionConfig | None = field(default_factory=SessionConfig)
    profile: ProfileConfig | None = field(default_factory=ProfileConfig)
    gaps: GapConfig | None = field(default_factory=GapConfig)
    retracement: RetracementConfig | None = field(default_factory=RetracementConfig)
    pools: PoolConfig | None = field(default_factory=PoolConfig)
    levels: LevelConfig | None = field(default_factory=LevelConfig)

    def signature(self) -> str:
        """Sixteen hex digits that name these settings."""
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class ExecutionConfig:
    """Costs, sizing and exits of the simulated trades."""

    balance: float = 10_000.0
    risk_percent: float = 1.0
    target_rr: float = 2.0
    commission_per_lot: float = 0.0
    spread_pips: float = 0.0
    slippage_pips: float = 0.2
    cooldown: int = 0
    runner: str = "sr_atr_trail"
    trail_atr: float = 1.0
    session_factors: tuple[float, float, float] = (0.85, 1.00, 1.20)
    volatility_levels: tuple[float, float] = (1.20, 1.50)
    volatility_factors: tuple[float, float] = (1.15, 1.35)
    slippage_bounds: tuple[float, float] = (0.75, 2.50)
    partial: float = 0.30
    pip: float = 0.0001
    tick_size: float | None = None
    tick_value: float | None = None
    contract_size: float | None = None
    volume_min: float = 0.01
    volume_max: float = 100.0
    volume_step: float = 0.01

    def __post_init__(self):
        _check(self.runner in ("none", "sr_only", "sr_atr_trail"), "unknown runner mode")
        _check(self.balance > 0 and self.target_rr > 0, "balance and target must be positive")

    @property
    def cash_per_unit(self) -> float:
        """Cash for a price move of one, per lot."""
        if self.tick_size and self.tick_value and self.tick_size > 0 and self.tick_value > 0:
            return self.tick_value / self.tick_size
        return self.contract_size if self.contract_size and self.contract_size > 0 else 1.0


#: Settings for the bars of the test data, whose prices run from 0 to 490.
DEMO = FeatureConfig(pip=25.0, profile=ProfileConfig(decimals=0, tolerance=5.0), pools=PoolConfig(tolerance=10.0), gaps=GapConfig())
DEMO_EXECUTION = ExecutionConfig(commission_per_lot=6.0, spread_pips=0.02, slippage_pips=0.01, pip=25.0, contract_size=1.0, session_factors=(0.85, 1.00, 1.25), volatility_factors=(1.20, 1.70))
