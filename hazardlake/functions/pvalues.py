"""Tail probabilities that Spark SQL lacks, as column expressions.

Series and continued fractions run as ``aggregate`` from their last term to the first, so every row
takes the same steps and no Python worker is started.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import STIRLING

#: Terms of a series or fraction, and the argument from which Stirling's series is used. Relative errors stay
#: below 1e-12 up to 100,000 degrees of freedom and grow in proportion beyond (4e-9 at 10^9).
TERMS, SHIFT = 120, 12


def _column(c) -> Column:
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def _backwards(start: Column, step) -> Column:
    """``step(value, k)`` for k from the last term to 1."""
    return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), start, lambda v, k: step(v, k.cast("double")))


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: a series below 2, a continued fraction above."""
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    series = _backwards(F.lit(1.0), lambda h, k: 1.0 + h * (2.0 * z * z) / (2.0 * k + 1.0))
    fraction = _backwards(F.lit(0.0), lambda t, k: k / 2.0 / (z + t))
    return F.when(z < 2.0, 1.0 - 2.0 * z * scale * series).otherwise(scale / (z + fraction))


def _stirling(x: Column) -> Column:
    """What Stirling's series adds to (x - 1/2) ln x - x + ln(2 pi) / 2."""
    return sum((F.lit(c) / F.pow(x, F.lit(2.0 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))


def _ln_product(x: Column) -> Column:
    return sum((F.ln(x + float(i)) for i in range(SHIFT)), F.lit(0.0))


def _ln_gamma(x: Column) -> Column:
    y = x + float(SHIFT)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + _stirling(y) - _ln_product(x)


def _ln_gamma_growth(x: Column, by: Column) -> Column:
    """ln Gamma(x + by) - ln Gamma(x), without subtracting two large numbers."""
    y = x + float(SHIFT)
    ratio = sum((F.log1p(by / (x + float(i))) for i in range(SHIFT)), F.lit(0.0))
    return (y - 0.5) * F.log1p(by / y) + by * F.ln(y + by) - by + _stirling(y + by) - _stirling(y) - ratio


def beta_lower(a: Column, b: Column, ln_x: Column, ln_1_x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b), from the logarithms of x and of 1 - x."""
    front = F.exp(a * ln_x + b * ln_1_x + _ln_gamma_growth(F.greatest(a, b), F.least(a, b)) - _ln_gamma(F.least(a, b)))

    def fraction(a, b, x):
        def step(h, m):
            odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
            even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
            return 1.0 + even / (1.0 + odd / h)
        return 1.0 - (a + b) * x / (a + 1.0) / _backwards(F.lit(1.0), step)

    x, y = F.exp(ln_x), F.exp(ln_1_x)
    return F.when(x <= (a + 1.0) / (a + b + 2.0), front / a / fraction(a, b, x)).otherwise(1.0 - front / b / fraction(b, a, y))


def normal_two_sided(z) -> Column:
    """P(|Z| >= |z|) of a standard normal Z."""
    return erfc(F.abs(_column(z)) / math.sqrt(2))


def chi2_sf(x, df=None) -> Column:
    """P(X >= x) for whole degrees of freedom, one if ``df`` is not given; NULL below one.

    The finite sums over the halves of ``df``: powers of x / 2 by their factorials, to which odd ones add erfc.
    """
    y = F.greatest(_column(x), F.lit(0.0)) / 2.0
    y = F.when(_column(x).isNotNull(), y)
    one = erfc(F.sqrt(y))
    if df is None:
        return one
    k = _column(df).cast("int")
    odd, terms = (k % 2).cast("double"), F.floor(k / 2).cast("int")
    first = F.struct((odd / 2.0 * F.ln(y) - y - odd * math.log(math.sqrt(math.pi) / 2)).alias("ln"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), first, lambda s, j: F.struct(
        (s["ln"] + F.ln(y) - F.ln(j.cast("double") + odd / 2.0)).alias("ln"), (s["sum"] + F.exp(s["ln"])).alias("sum")))["sum"]
    return (F.when(y.isNull() | k.isNull() | (k < 1), F.lit(None).cast("double")).when(y == 0, F.lit(1.0))
            .when(k == 1, one).otherwise(total + F.when(odd == 1, one).otherwise(F.lit(0.0))))


def f_sf(f, df1, df2) -> Column:
    """P(X >= f) of the F distribution; NULL without degrees of freedom."""
    f, d1, d2 = _column(f), _column(df1), _column(df2)
    u = d1 * f / d2
    tail = beta_lower(d2 / 2.0, d1 / 2.0, -F.log1p(u), F.ln(u) - F.log1p(u))
    return F.when(f.isNull() | (d1 <= 0) | (d2 <= 0), F.lit(None).cast("double")).when(f <= 0, F.lit(1.0)).otherwise(tail)
