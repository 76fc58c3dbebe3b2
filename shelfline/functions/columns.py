"""Column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Money is summed as a decimal so that totals do not depend on row or partition order.
MONEY = "decimal(18,4)"

COMPLETED = "COMPLETED"
RETURNED = "RETURNED"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def total(c: str | Column) -> Column:
    """Order-independent sum of an amount, as a double."""
    return F.sum(money(c)).cast("double")


def units(c: str | Column) -> Column:
    """The amount or quantity of one sale line in ten-thousandths, as a whole decimal.

    Equal to ``money`` but several times cheaper per row: casting a double to a decimal with a scale goes
    through its text. Sums stay exact and cannot overflow.
    """
    return F.rint(col(c).cast("double") * 10000).cast("bigint").cast("decimal(18,0)")


def line_total(c: str | Column) -> Column:
    """``total`` for the amounts and quantities of single sale lines or days."""
    return F.sum(units(c)).cast("double") / 10000


def mean(amount: str | Column, weight: str | Column | None = None) -> Column:
    """Order-independent mean; with ``weight``, the mean of ``amount`` sums over ``weight`` counts."""
    count = F.count(col(amount)) if weight is None else F.sum(col(weight))
    return ratio(total(amount), count)


def ratio(num: Column, den: Column) -> Column:
    """Double division, null when the denominator is zero."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def pct(num: Column, den: Column) -> Column:
    return ratio(num.cast("double") * F.lit(100.0), den)


def growth_pct(cur: Column, prior: Column) -> Column:
    return ratio(cur - prior, prior) * F.lit(100.0)


def is_completed(status: str | Column = "status") -> Column:
    return col(status) == F.lit(COMPLETED)


def as_date(value) -> Column:
    """A date literal from ``YYYY-MM-DD`` or a ``date``; columns pass through as dates."""
    return value.cast("date") if isinstance(value, Column) else F.lit(str(value)).cast("date")


def within(day: str | Column, start, end) -> Column:
    """Closed date interval; both bounds are compared as dates."""
    return col(day).cast("date").between(as_date(start), as_date(end))


def week_start(day: str | Column) -> Column:
    """Monday of the week."""
    return F.trunc(col(day).cast("date"), "week")


def month_start(day: str | Column) -> Column:
    return F.trunc(col(day).cast("date"), "month")


def quarter_start(day: str | Column) -> Column:
    return F.trunc(col(day).cast("date"), "quarter")


def period_start(day: str | Column, period: str) -> Column:
    """Start of the ``day``, ``week``, ``month`` or ``quarter`` a date lies in."""
    return col(day).cast("date") if period == "day" else F.trunc(col(day).cast("date"), period)


def month_number(day: str | Column) -> Column:
    return F.year(col(day)) * 12 + F.month(col(day))


def month_offset(day: str | Column, start: str | Column, mode: str = "calendar") -> Column:
    """Whole months from ``start`` to ``day``, both month starts.

    ``days30`` divides elapsed days by 30, kept for comparison only: it puts 1 February to 1 March 2024
    in month 0.
    """
    if mode == "calendar":
        return month_number(day) - month_number(start)
    if mode == "days30":
        return F.floor(F.datediff(col(day), col(start)) / 30).cast("int")
    raise ValueError(f"unknown month mode {mode!r}")


def line_revenue(quantity: str | Column = "quantity", unit_price: str | Column = "unit_price") -> Column:
    return col(quantity) * col(unit_price)


def count_when(condition: Column) -> Column:
    """Rows for which the condition holds; zero, not null, when none does."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
