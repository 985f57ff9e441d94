"""Imports every module that registers queries."""

from checks import (  # noqa: F401
    extra_queries,
    feature_queries,
    filing_queries,
    model_queries,
    monthly_queries,
    seasonal_queries,
    walkforward_queries,
)
from checks.registry import ORACLES, QUERIES  # noqa: F401
