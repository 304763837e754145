from tallyvine.plans.reports import (
    campaign_series,
    complete_by_key,
    complete_by_position,
    explore,
    farm_profile,
    production_report,
)

__all__ = [
    "campaign_series",
    "complete_by_key",
    "complete_by_position",
    "explore",
    "farm_profile",
    "production_report",
]
