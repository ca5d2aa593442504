"""Number helpers as plain Column expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, str):
        return F.col(str(x))
    return F.lit(x) if isinstance(x, (int, float)) else x


class Name(str):
    """A column name with arithmetic, usable at module level before a session exists."""

    def _col(self) -> Column:
        return F.col(str(self))

    def __add__(self, other):
        return self._col() + other

    def __sub__(self, other):
        return self._col() - other

    def __mul__(self, other):
        return self._col() * other

    def __truediv__(self, other):
        return self._col() / other

    def __neg__(self):
        return -self._col()

    def __gt__(self, other):
        return self._col() > _c(other)

    def __ge__(self, other):
        return self._col() >= _c(other)

    def __lt__(self, other):
        return self._col() < _c(other)

    def __le__(self, other):
        return self._col() <= _c(other)


def lit(v) -> Column:
    return F.lit(float(v))


def rnd(x, digits: int) -> Column:
    """Round half away from zero; NaN and infinities stay, and nothing saturates, since all of it is double arithmetic.

    What is closer to a tie than float noise counts as the tie, so sums taken in another order round alike: the nudge is
    1e-8 of the last kept digit, and grows with the value's own noise to at most 1e-6.
    """
    scale = lit(10**digits)
    y = F.abs(_c(x)) * scale
    # the added 0 turns -0.0 into 0.0
    return F.signum(_c(x)) * F.rint(y + lit(1e-8) + F.least(lit(1e-6), y * lit(1e-14))) / scale + lit(0)


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.least(_c(x), lit(hi)), lit(lo))


def safe_ratio(num, den, default: float | None = 0.0) -> Column:
    """num / den, or the default when the denominator is missing or not positive."""
    other = F.lit(None).cast("double") if default is None else lit(default)
    return F.when(_c(den) > 0, _c(num) / _c(den)).otherwise(other)


def parse_number(x) -> Column:
    """Numeric text to double: blanks, '-' and 'null' count as 0, thousands commas are dropped."""
    cleaned = F.regexp_replace(F.trim(_c(x).cast("string")), ",", "")
    return F.coalesce(cleaned.try_cast("double"), lit(0))


def parse_percent(x) -> Column:
    """'12.34%' or '12.34' to 0.1234."""
    return parse_number(F.regexp_replace(F.trim(_c(x).cast("string")), "%$", "")) / lit(100)


def floor_lot(qty, lot: int = 100) -> Column:
    return F.floor(_c(qty) / lit(lot)) * F.lit(lot)


def first_non_zero(*cols) -> Column:
    """First value that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(_c(c).cast("double"), lit(0)) for c in cols], lit(0))


def erfc(x) -> Column:
    """Complementary error function, Abramowitz-Stegun 7.1.26 (absolute error below 1.5e-7)."""
    # fixed values: coefficients of formula 7.1.26
    p = 0.3275911
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(_c(x))
    t = lit(1) / (lit(1) + lit(p) * z)
    poly = t * (lit(a[0]) + t * (lit(a[1]) + t * (lit(a[2]) + t * (lit(a[3]) + t * lit(a[4])))))
    tail = poly * F.exp(-z * z)
    return F.when(_c(x) >= 0, tail).otherwise(lit(2) - tail)


def two_sided_p(t) -> Column:
    """Normal-tail p value of a t statistic."""
    return erfc(F.abs(_c(t)) / lit(2**0.5))


def display_amount(x) -> Column:
    """Amounts in units of 1e8 and 1e4, two decimals."""
    v = _c(x)
    return (
        F.when(v >= 1e8, F.concat(F.format_string("%.2f", rnd(v / lit(1e8), 2)), F.lit("亿")))
        .when(v >= 1e4, F.concat(F.format_string("%.2f", rnd(v / lit(1e4), 2)), F.lit("万")))
        .otherwise(F.format_string("%.2f", rnd(v, 2)))
    )
