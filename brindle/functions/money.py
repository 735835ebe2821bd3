from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = Decimal("0.0001")


def money(amount: Column) -> Column:
    """Exact two-decimal amount.

    Sums of doubles depend on the order in which tasks deliver rows; sums of
    decimals do not, so they survive any repartitioning or retry unchanged.
    """
    return amount.cast("decimal(15,2)")


def _within_quarter(scaled: Column, bound: float) -> Column:
    return (F.abs(scaled - F.rint(scaled)) < 0.25) & (F.abs(scaled) < bound)


def _scaled(price: Column, discount: Column) -> tuple[Column, Column]:
    """Cents and percent as doubles: in the columns' own types they could overflow or round."""
    return price.cast("double") * 100, discount.cast("double") * 100


def _in_integers(price: Column, discount: Column) -> Column:
    cents, percent = _scaled(price, discount)
    return _within_quarter(cents, 1e12) & _within_quarter(percent, 1e4)


def discounted_units(price: Column, discount: Column) -> Column:
    """``money(price) * (1 - money(discount))``, counted in units of 0.0001.

    NULL where either amount is NULL, NaN or beyond ``money``; see ``beyond_money``.
    Amounts may be of any numeric type.

    Turning a double into a decimal goes through its printed digits, and
    decimals beyond 18 digits are objects, which costs more than the rest of the
    query. Where both amounts lie well within half a cent of a whole number of
    cents there is only one way to round them, and the product is computed in
    64-bit integers: below the bounds it has at most 17 digits, and the error of
    the scaling is far less than the quarter cent to spare. All other rows take
    the decimal cast.
    """
    cents, percent = _scaled(price, discount)
    in_integers = F.rint(cents).cast("bigint") * (100 - F.rint(percent).cast("bigint"))
    known = price.try_cast("decimal(15,2)") * (F.lit(1) - discount.try_cast("decimal(15,2)"))
    return F.when(_in_integers(price, discount), in_integers.cast("decimal(18,0)")).otherwise(
        (known / F.lit(UNIT)).cast("decimal(38,0)")
    )


def _beyond(amount: Column) -> Column:
    number = amount.cast("double")
    return amount.try_cast("decimal(15,2)").isNull() & number.isNotNull() & ~F.isnan(number)


def beyond_money(price: Column, discount: Column) -> Column:
    """1 where ``money`` of either amount would be out of range, else 0."""
    beyond = _beyond(price) | _beyond(discount)
    return F.when(_in_integers(price, discount), 0).when(beyond, 1).otherwise(0).cast("bigint")


def from_units(units: Column) -> Column:
    """The amount for a number of units, as ``decimal(38,4)``."""
    return (units * F.lit(UNIT)).cast("decimal(38,4)")


def unless_beyond(amount: Column, beyond: Column) -> Column:
    """``amount``; under ANSI an error if ``beyond``, a count, is not zero."""
    # a cast that is out of range: it raises under ANSI and is NULL, here 0, otherwise
    check = F.when(beyond > 0, F.lit(1e15)).cast("decimal(15,2)")
    return F.when(F.coalesce(check, F.lit(0)) == 0, amount)
