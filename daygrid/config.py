"""Every threshold of the engine in one frozen object."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # panel alignment
    max_fill_days: int = 7
    # cross-sections: above this many names per date the ranked operators stop
    # using one window partition per date and split each date into value ranges
    window_names_limit: int = 500_000
    value_ranges: int = 64
    # rows that one task sorts when groups are split into ranges
    range_rows: int = 200_000
    # entities of a wide panel per task of an entity or date window
    names_per_task: int = 200
    winsor_lower: float = 0.01
    winsor_upper: float = 0.99
    min_names_rank: int = 3
    min_names_ic: int = 5
    min_nonzero_obs: int = 8
    max_pairwise_corr: float = 0.12
    # universe
    min_mcap: float = 100_000_000.0
    min_volume: float = 10_000_000.0
    min_listing_days: int = 30
    min_history_weeks: int = 13
    base_volume: float = 1_000_000.0
    sensitivity_volume: float = 10_000_000.0
    min_price_history_days: int = 90
    max_positions: int = 8
    # exposure overlay
    sma_days: int = 140
    vol_target: float = 0.15
    vol_days: int = 56
    dd_start: float = -0.10
    dd_floor: float = -0.20
    max_leverage: float = 1.5
    min_exposure: float = 0.25
    # research
    horizons: tuple[int, ...] = (7, 14, 30)
    primary_horizon: int = 14
    tx_cost_bps: float = 50.0
    short_rank_buffer: int = 10
    basket_size: int = 5
    weight_step: float = 0.05
    max_family_weight: float = 0.60
    dedupe_corr: float = 0.90
    search_every: int = 30
    shortlist: int = 60
    improvement_rows: int = 28
    # screener
    stale_days: int = 14
    min_candidate_mcap: float = 50_000_000.0
    min_candidate_tvl: float = 50_000_000.0
    min_candidate_volume: float = 1_000_000.0
    max_candidates: int = 350
    chain_quota: int = 50
    history_days: int = 120
    display_days: int = 30
    factor_lag_rows: int = 30
    redundant_corr: float = 0.98


@dataclass(frozen=True)
class Periods:
    """Train, validation and test bounds of one research run."""

    train_start: dt.date = dt.date(2024, 5, 1)
    train_end: dt.date = dt.date(2025, 4, 30)
    validation_start: dt.date = dt.date(2025, 5, 1)
    validation_end: dt.date = dt.date(2025, 10, 31)
    test_start: dt.date = dt.date(2025, 11, 1)


SETTINGS = Settings()

# Factor families and their weightings.
FAMILIES = ("fundamentals", "momentum", "flows", "factor_improvement")
FAMILY_WEIGHTS = {"fundamentals": 0.55, "momentum": 0.175, "flows": 0.125, "team": 0.15}
PRESET_WEIGHTS = {
    "current_no_team": {"fundamentals": 0.55 / 0.85, "momentum": 0.175 / 0.85, "flows": 0.125 / 0.85, "factor_improvement": 0.0},
    "equal_family": {"fundamentals": 0.25, "momentum": 0.25, "flows": 0.25, "factor_improvement": 0.25},
    "heuristic": {"fundamentals": 0.25, "momentum": 0.40, "flows": 0.25, "factor_improvement": 0.10},
}

# Half-open [low, high) value buckets.
VALUE_BUCKETS = (
    ("Micro", 0.0, 100_000_000.0),
    ("Small", 100_000_000.0, 500_000_000.0),
    ("Mid", 500_000_000.0, 1_000_000_000.0),
    ("Large", 1_000_000_000.0, 5_000_000_000.0),
    ("Mega", 5_000_000_000.0, None),
)
