"""End-to-end plans composed of the operators."""

from vulnspark.plans.advisories import (
    collect_records,
    features_from_raw,
)
from vulnspark.plans.consumers import dashboard, eda_report, explanations

__all__ = [
    "collect_records",
    "dashboard",
    "eda_report",
    "explanations",
    "features_from_raw",
]
