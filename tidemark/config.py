"""Screening thresholds and run parameters.

The defaults are fixed values: results only agree with the published model
when these numbers do. Variants are made with ``dataclasses.replace``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Quality gate.
    min_growth: float = 0.15
    min_margin: float = 0.40
    margin_slack: float = 0.05
    min_roic: float = 0.15
    max_leverage: float = 1.0
    min_runway_months: float = 24
    max_peg: float = 2.0
    max_ps: float = 15.0
    min_growth_unprofitable: float = 0.30
    min_fcf_yield: float = 0.015
    default_tax: float = 0.21
    tax_ceiling: float = 0.6

    # Entry timing.
    vix_fear: float = 25.0
    below_trend: float = 0.10
    market_drawdown: float = 0.10
    sentiment_fear: float = 35.0
    fear_votes: int = 2
    zscore_floor: float = -1.5
    off_high: float = 0.20
    momentum_floor: float = 0.10
    ps_history_days: int = 1095
    ps_quantile: float = 0.25
    ema_tolerance: float = 0.90

    # Exits.
    exit_negative_periods: int = 2
    exit_margin: float = 0.30
    exit_leverage: float = 2.0
    max_hold_days: int = 1825
    trailing_stop: float = 0.15
    atr_period: int = 22
    atr_multiple: float = 3.0
    stop_grace_days: int = 30

    # Panel windows and portfolio.
    lag_days: int = 45
    min_history: int = 60
    year_rows: int = 252
    warmup_rows: int = 120
    month_rows: int = 21
    half_year_rows: int = 126
    top_n: int = 10
    sector_cap: float = 0.35
    position_size: float = 0.10
    capital: float = 1_000_000.0
    risk_free: float = 0.03
    simulations: int = 10_000
    alert_score: int = 11
    qvm_variant: str = "composite"


DEFAULT = Settings()
