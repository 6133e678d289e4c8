"""Named queries over the driver's tables, each with the SQL it must agree with."""

from catalog import alerts, derive, health, news, reports, scans, series, sinks
from catalog.base import REGISTRY

__all__ = ["REGISTRY", "alerts", "derive", "health", "news", "reports", "scans", "series", "sinks"]
