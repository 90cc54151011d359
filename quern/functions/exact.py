"""Sums of decimal amounts that are stored as doubles.

A double sum depends on the order of addition, which differs from run to run.
Casting every double to a decimal is exact, but took ten times as long in our
measurements as the whole numbers of smallest units used here. So amounts with no
more than the stated decimals are summed as such whole numbers, and only amounts with
more are summed as decimals, with up to :data:`FINEST` digits.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most decimals an amount may have; one with more raises an error.
FINEST = 6

_LOW_BITS = 20

#: Decimal types of the only factor, of the first of several, and of each other one, so
#: that the product of three is still exact; and the amounts that they do not hold.
_ONLY, _FIRST, _OTHER = "decimal(22,6)", "decimal(18,6)", "decimal(9,6)"
_LIMITS = {_ONLY: 9e15, _FIRST: 1e12, _OTHER: 1e3}

#: Whole numbers of smallest units, and their products, that a long does not hold.
_MOST_UNITS = 9.2e18


def _either(factors: tuple[tuple[Column, int], ...], name: str | None) -> tuple[Column, Column]:
    """The product in whole units or else as a decimal; one of the two is null."""
    units, size, finer, large = None, None, F.lit(False), F.lit(False)
    for column, decimals in factors:
        scaled = column * F.lit(float(10**decimals))
        whole = F.rint(scaled)
        # Off by more than the error of a double; so is the infinite.
        off = F.abs(whole) * F.lit(2.3e-16) + F.lit(1e-5)
        # Beyond 2^53 doubles leave out whole numbers, and NaN is beyond it.
        finer = finer | (F.abs(scaled - whole) > off) | (F.abs(scaled) > F.lit(2.0**53))
        if size is not None:
            large = large | (F.abs(size * scaled) >= F.lit(_MOST_UNITS))
        size = scaled if size is None else size * scaled
        whole = whole.cast("bigint")
        units = whole if units is None else units * whole
    exact = f"decimal(38,{FINEST * len(factors)})"
    fine, finite, too_fine, too_large = None, F.lit(True), F.lit(False), F.lit(False)
    for i, (column, _) in enumerate(factors):
        kind = _OTHER if i else _FIRST if len(factors) > 1 else _ONLY
        micros = column * F.lit(float(10**FINEST))
        off = F.abs(micros) * F.lit(1e-15) + F.lit(1e-6)
        too_fine = too_fine | (F.abs(micros - F.rint(micros)) > off)
        too_large = too_large | (F.abs(column) >= F.lit(_LIMITS[kind]))
        finite = finite & (F.abs(column) < F.lit(float("inf")))
        part = column.cast(kind)
        fine = part if fine is None else fine * part
    label = name or factors[0][0]._jc.toString()
    error = lambda what: F.raise_error(F.lit(f"an amount in {label} {what}"))
    big = error("is too large to be summed exactly")
    small = error(f"has more than {FINEST} decimals")
    fine = F.when(too_large, big.cast(exact)).when(too_fine, small.cast(exact)).otherwise(fine.cast(exact))
    units = F.when(large, big.cast("bigint")).otherwise(units)
    return F.when(~finer, units), F.when(finer & finite, fine)


def _total(units: Column, fine: Column, decimals: int, factors: int) -> Column:
    exact, room = f"decimal(38,{FINEST * factors})", f"decimal(35,{FINEST * factors})"
    # High and low bits apart, so that trillions of rows overflow neither sum.
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(19,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(19,0)")
    unit = F.lit(Decimal(1).scaleb(-decimals))
    whole = ((high * F.lit(1 << _LOW_BITS) + low) * unit).cast(f"decimal(36,{decimals})")
    # A sum of decimals costs several times as much, even of nulls. So the decimals,
    # rare as they are, are summed as longs too: whole part, then six digits at a time.
    rest = F.sum(fine.cast("bigint")).cast("decimal(20,0)").cast(room)
    digits = fine % F.lit(Decimal(1))
    for place in range(1, factors + 1):
        moved = digits * F.lit(Decimal(10**FINEST))
        piece = F.sum(moved.cast("bigint")).cast("decimal(20,0)")
        rest = rest + (piece * F.lit(Decimal(1).scaleb(-FINEST * place))).cast(room)
        digits = moved % F.lit(Decimal(1))
    whole, rest = whole.cast(room), rest.cast(room)
    return F.coalesce(whole + rest, whole, rest).cast(exact)


def amount(*factors: tuple[Column, int], name: str | None = None) -> Column:
    """The product of amounts, ready for :func:`sum_of_amounts`.

    Each factor is ``(column, decimals)``. The product is a struct of ``units``, a whole
    number of its smallest unit, and ``fine``, a decimal; one of the two is null, the
    first where any factor has more decimals than stated. A factor that is null,
    NaN or infinite makes the product null. More than :data:`FINEST` decimals, beyond
    the error of a double, raise an error that names the column (``name`` or the
    first factor's). So do amounts too large: a product of 9.2e18 units or more, or, where
    a factor has more decimals than stated or 2^53 units, 9e15 alone, 1e12 as the first of
    several factors or 1000 as another.
    """
    units, fine = _either(factors, name)
    return F.struct(units.alias("units"), fine.alias("fine"))


def sum_of_amounts(column: Column, decimals: int, factors: int = 1) -> Column:
    """The sum of a column of :func:`amount`, as a decimal; null of nothing but nulls.

    ``decimals`` are those of the product's unit.
    """
    return _total(column["units"], column["fine"], decimals, factors)


def exact_sum(*factors: tuple[Column, int]) -> Column:
    """The sum of a product of amounts, exact to its last decimal (see :func:`amount`)."""
    return _total(*_either(factors, None), sum(d for _, d in factors), len(factors))


def shown(total: Column) -> Column:
    """A total as the queries show it: to :data:`FINEST` decimals, half up, as a double."""
    return total.cast(f"decimal(38,{FINEST})").cast("double")
