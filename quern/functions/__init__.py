"""Column expressions; all of them stay in built-in functions."""

from quern.functions.exact import amount, exact_sum, shown, sum_of_amounts
from quern.functions.moments import (
    micros_between,
    seconds_of,
    utc_instant,
    utc_wall_clock,
)

__all__ = [
    "amount",
    "exact_sum",
    "micros_between",
    "seconds_of",
    "shown",
    "sum_of_amounts",
    "utc_instant",
    "utc_wall_clock",
]
