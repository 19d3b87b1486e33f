"""Parameters of a channel workload. The window, domains and thresholds are data, not code."""
from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from .functions.calendar import qlabel


# Thresholds that define the results.
OUTLIER_MULTIPLE = 20.0
OUTLIER_QUANTILE = 0.99
RAMPING_MONTHS = 12
DAYS_PER_MONTH = 30.44
DOWN_QUARTER = -0.10
RATIO_CAP = 5.0
RECENCY_CAP = 20.0
WINSOR = (0.01, 0.99)
TOKEN_SHARE = 0.10
RECOVER_SHARE = 0.30
COVERAGE = 0.80
FLAG_MULTIPLIERS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]
HEALTH_EDGES = [0, 50, 60, 70, 80, 90, 95, 97, 98, 99, 100]
SEGMENTS = ["At risk", "Quietly declining", "Ramping (new)", "Stable", "Growing"]
PARTNER_SORTS = ["revenue_range", "health_score", "p_leave", "risk_rank", "yoy_h1_pct", "margin_pct",
                 "days_since_last_order", "partner_name", "revenue_last_q"]


@dataclass(frozen=True)
class ChannelSettings:
    start: date = date(2024, 1, 1)
    end: date = date(2026, 6, 30)
    regions: tuple[str, ...] = ("AMS", "APJ", "EMEA")
    tiers: tuple[str, ...] = ("Platinum", "Gold", "Silver", "Business")
    families: tuple[str, ...] = ()
    partner_types: tuple[str, ...] = ("Distributor", "Reseller", "Service Provider")
    domains: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        self.domains.update({"region": self.regions, "tier": self.tiers, "product_family": self.families,
                             "partner_type": self.partner_types})
    #: Snapshots on which the rolling backtest of leave risk is judged.
    holdouts: int = 4

    @property
    def cohort_old(self) -> str:
        return f"Onboarded pre-{self.start.year}"

    @property
    def cohort_new(self) -> str:
        return f"Onboarded {self.start.year}+"

    @property
    def first_q(self) -> int:
        return self.start.year * 4 + (self.start.month - 1) // 3

    @property
    def last_q(self) -> int:
        return self.end.year * 4 + (self.end.month - 1) // 3

    @property
    def quarters(self) -> list[str]:
        return [qlabel(i) for i in range(self.first_q, self.last_q + 1)]

    @property
    def score_cutoff(self) -> str:
        return qlabel(self.last_q)

    @property
    def target_quarter(self) -> str:
        return qlabel(self.last_q + 1)

    @property
    def train_cutoffs(self) -> list[str]:
        """Snapshots with four quarters of history and a known next quarter."""
        return [qlabel(i) for i in range(self.first_q + 3, self.last_q)]

    @property
    def eval_cutoffs(self) -> list[str]:
        """The last `holdouts` snapshots that have two or more before them."""
        return self.train_cutoffs[2:][-self.holdouts:]

    @property
    def backtest_quarters(self) -> list[str]:
        return [qlabel(i) for i in range(self.last_q - 4, self.last_q + 1)]
