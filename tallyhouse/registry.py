"""Every registered query: key -> (tables -> DataFrame)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyhouse.plans import drilldowns, jobs, learning, metrics

Query = Callable[..., DataFrame]


def _metric(key: str) -> Query:
    return lambda t: metrics.scalar(t, key)


def _tab(tab: str) -> Query:
    return lambda t: metrics.tab_summary(t, tab)


QUERIES: dict[str, Query] = {
    **{key: _metric(key) for key in metrics.METRICS},
    **{f"M-44_tab_summary_{tab.replace('-', '_')}": _tab(tab) for tab in metrics.TABS},
    "M-45_health_check": metrics.health_check,
    "M-46_trend": lambda t: metrics.trend(metrics.hourly_snapshots(t)),
    **drilldowns.DRILLS,
    **drilldowns.ANALYSES,
    **drilldowns.FORMULAS,
    **jobs.JOBS,
    **learning.LEARNING,
}
