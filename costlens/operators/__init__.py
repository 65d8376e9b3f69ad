from . import (
    anomaly,
    budget,
    decision,
    filters,
    forecast,
    opportunity,
    panel,
    pricing,
    quality,
    replay,
    scenario,
    spend,
)

__all__ = [
    "anomaly",
    "budget",
    "decision",
    "filters",
    "forecast",
    "opportunity",
    "panel",
    "pricing",
    "quality",
    "replay",
    "scenario",
    "spend",
]
