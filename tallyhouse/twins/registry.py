"""Every DuckDB twin: key -> statement that runs on the stored tables alone."""

from __future__ import annotations

from tallyhouse.twins import catalogue, jobs, learning
from tallyhouse.twins.views import with_views


def statements() -> dict[str, str]:
    twins = {**catalogue.TWINS, **jobs.TWINS, **learning.TWINS}
    return {key: with_views(sql, {**jobs.VIEWS, **learning.VIEWS}) for key, sql in twins.items()}
