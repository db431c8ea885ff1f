"""Constants that define semantics; every window, threshold and date is an argument of the operators."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400_000_000  # microseconds


@dataclass(frozen=True)
class Config:
    horizon_days: int = 30
    step_days: int = 30
    horizons: tuple[int, ...] = (30, 60, 90, 120)
    fleet_days: int = 90
    density_days: tuple[int, ...] = (90, 180)
    model_support: int = 300
    type_support: int = 20
    # fixed values: age bands, right-open
    age_bands: tuple[tuple[int, str], ...] = ((91, "000_090_DAYS"), (181, "091_180_DAYS"), (366, "181_365_DAYS"), (731, "366_730_DAYS"), (1461, "731_1460_DAYS"))
    last_band: str = "1461_PLUS_DAYS"
    high: float = 0.25
    medium: float = 0.15
    # dates of the data at hand
    first_observation: str = "1996-01-01"
    scrap_era: str = "1998-01-01"
    oldest_date: str = "1971-01-01"
    now: str = "2100-01-01"
    fuzzy_score: float = 0.90
    fuzzy_margin: float = 0.08
    abbreviations: tuple[tuple[str, str], ...] = (("JKT", "JAKARTA"),)
    client_alias: tuple[tuple[str, str], ...] = ()
    place_alias: tuple[tuple[str, str], ...] = ()
    capacity_per_month: float = 200.0
    scrap_per_month: float = 3.0
    days_per_month: float = 30.0


DEFAULT = Config()
BROKEN = ("UNREPAIRABLE", "BROKEN", "SENDLOG (BROKEN)")
REPAIRED = "REPAIRED"
UNKNOWN = "UNKNOWN"
LOW_SUPPORT = "LOW_HISTORICAL_SUPPORT"
LOW_TYPE = "LOW_SUPPORT"
