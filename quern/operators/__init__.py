"""Reusable DataFrame-to-DataFrame steps."""

from quern.operators.cells import cube_of, rollup_of
from quern.operators.keys import latest_per_key, top_per_key, without_match
from quern.operators.ordered import by_load, with_prior, with_running_sum
from quern.operators.quantiles import exact_quantile
from quern.operators.sessions import sessions

__all__ = [
    "by_load",
    "cube_of",
    "exact_quantile",
    "latest_per_key",
    "rollup_of",
    "sessions",
    "top_per_key",
    "with_prior",
    "with_running_sum",
    "without_match",
]
