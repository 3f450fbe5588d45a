"""All registered queries."""

from checks import features, forecast, joins, reports, sources  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
