"""All knobs in one frozen object, passed to the operators that need them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

BANDS = ("junior", "mid", "senior", "staff")
REVIEWS = ("review", "approved", "changes_requested")
# The closed vocabulary of activities.
ACTIVITIES = (
    "commit", "review_requested", "review", "changes_requested", "approved", "merged", "reopened", "force_push", "ci_run", "deploy",
    "ticket_created", "ticket_started", "ticket_in_review", "ticket_resolved", "ticket_closed", "ticket_reopened", "meeting",
)
SOURCES = ("github", "jira", "synthetic")
# First words of a publisher or address that stand for a missing one.
PLACEHOLDERS = ("todo", "tbd", "fill", "xxx", "changeme", "change-me", "none", "na", "n/a", "unknown", "?")
PLACEHOLDER = re.compile("(?i)(" + "|".join(map(re.escape, PLACEHOLDERS)) + ")(?![a-z0-9])")
# Names that are kept for examples and never belong to a source.
EXAMPLE_HOST = re.compile(r"(?i)https?://([^/]*\.)?(example(\.(org|com|net))?|localhost|[^/]*\.(test|invalid))(?![a-z0-9.-])")


@dataclass(frozen=True)
class Citation:
    """Where a figure comes from. A figure whose citation is incomplete is not used."""

    publisher: str = ""
    url: str = ""
    retrieved: str = ""

    @property
    def complete(self) -> bool:
        parts = self.retrieved.split("-")
        dated = [len(p) for p in parts] == [4, 2, 2] and all(p.isdigit() for p in parts) and 1 <= int(parts[1]) <= 12 and 1 <= int(parts[2]) <= 31
        named = all(part.strip() and not PLACEHOLDER.match(part.strip()) for part in (self.publisher, self.url))
        return bool(named and dated and re.match(r"https?://[^/\s]+\.[^/\s]+", self.url.strip()) and not EXAMPLE_HOST.match(self.url.strip()))


@dataclass(frozen=True)
class Params:
    """What results depend on must equal the published rules and figures."""

    k: int = 5
    k_fallback: int = 3
    gap_minutes: int = 480
    lead_in_minutes: int = 30
    cap_hours: float = 10.0
    sprint_days: int = 14
    gap_sweep: tuple[int, ...] = (90, 240, 480, 1440)
    hours_per_engineer_year: int = 1840
    meeting_hours_per_week: float = 4.0
    significance_pct: float = 90.0
    rare_cases: int = 5
    rare_limit: int = 10
    umbrella_multiple: float = 10.0
    umbrella_prs: int = 8
    ramp_weeks: int = 6
    ramp_efficiency: float = 0.5
    cv_to_spread: float = 35.0
    min_spread: float = 12.0
    max_spread: float = 55.0
    min_group_samples: int = 20
    max_cycle_hours: float = 2160.0
    min_actual_for_pct: int = 3
    excluded_from_map: tuple[str, ...] = ("meeting",)
    # annual figures by band, ascending; loading, days and hours turn them into hourly rates
    annual: tuple[Decimal, ...] = (Decimal(1660000), Decimal(2953971), Decimal(4830000), Decimal(6950000))
    loading: Decimal = Decimal("1.30")
    working_days: int = 230
    hours_per_day: int = 8
    currency: str = "INR"
    rate_citation: Citation = Citation("Levels.fyi, salaries of software engineers in India (percentiles, self-reported)", "https://www.levels.fyi/t/software-engineer/locations/india", "2026-08-09")
    ci_per_minute: Decimal | None = Decimal("0.57126")
    ci_citation: Citation = Citation("GitHub Docs, billing for Actions (standard Linux runner), converted at the ECB reference rate", "https://docs.github.com/en/billing/managing-billing-for-your-products/about-billing-for-github-actions", "2026-08-09")
    grid_kg_per_kwh: Decimal | None = None
    runner_watts: Decimal | None = None
    carbon_citation: Citation = Citation()
    token_in_per_million: Decimal = Decimal("3.00")
    token_out_per_million: Decimal = Decimal("15.00")
    token_fx: Decimal = Decimal("95.21")
    # band -> floors that must all be met, most senior first
    band_floors: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = (
        ("staff", (("tenure_months", 24), ("reviews", 100))),
        ("senior", (("tenure_months", 12), ("merged", 30))),
        ("mid", (("tenure_months", 6),)),
    )
    band_targets: tuple[tuple[str, float], ...] = (("staff", 10), ("senior", 30), ("mid", 40), ("junior", 20))
    threshold_sweep: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("tenure_months", (3, 6, 9, 12, 18, 24, 36)),
        ("reviews", (5, 10, 25, 50, 100, 200)),
        ("merged", (1, 5, 10, 20, 30, 50)),
    )
    seconds_per_month: float = 2_629_746.0


DEFAULT = Params()
