"""Column expressions of the study; all stay inside the JVM."""

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

FIVE_YEARS = 1825


def barcode(col, length: int = 19) -> Column:
    """Sample barcode: the leading part of a specimen barcode."""
    return F.substring(col, 1, length)


def nth_part(col, sep: str, n: int) -> Column:
    """n-th part of at most n parts; the last one keeps the remainder, missing parts are ''."""
    parts = F.split(col, "\\Q" + sep + "\\E", n)
    return F.coalesce(F.get(parts, F.lit(n - 1)), F.when(F.col(col).isNotNull(), F.lit("")))


def first_of_list(col, sep: str = ";") -> Column:
    """'A;B;C' becomes 'A'."""
    return F.regexp_replace(col, f"{sep}.*$", "")


def null_if_in(col, values) -> Column:
    return F.when(~F.col(col).isin(list(values)), F.col(col))


def to_number(col) -> Column:
    """Text that is no number becomes NULL instead of an error."""
    return F.col(col).try_cast("double")


def survival_time(death: str = "days_to_death", follow_up: str = "days_to_last_follow_up") -> Column:
    return F.coalesce(F.col(death), F.col(follow_up))


def event_flag(vital: str = "vital_status", dead: str = "Dead") -> Column:
    return F.when(F.col(vital) == dead, 1).when(F.col(vital).isNotNull(), 0)


def volume(*dims: str) -> Column:
    return functools.reduce(operator.mul, [F.col(d) for d in dims])


def beta_to_m(col="value") -> Column:
    """log2(b / (1 - b)); NULL outside (0, 1), where the M-value is not finite."""
    b = F.col(col)
    return F.when((b > 0) & (b < 1), F.log2(b / (1 - b)))


def recode(col, mapping: dict) -> Column:
    """Relabel by a literal map; values without an entry stay."""
    if not mapping:
        return F.col(col)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.col(col))


def volcano_label(lfc="log2_fold_change", padj="padj", cut: float = 0.58, alpha: float = 0.05) -> Column:
    sig = F.col(padj) < alpha
    return (F.when((F.col(lfc) > cut) & sig, "UP")
             .when((F.col(lfc) < -cut) & sig, "DOWN").otherwise("NO"))


def neg_log10(col) -> Column:
    return -F.log10(col)


def hash_order(cols, seed: int) -> Column:
    """Pseudo-random order of rows that depends on the keys and the seed alone."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def hash_uniform(cols, seed: int) -> Column:
    """Uniform number in (0, 1), the same on every cluster layout."""
    head = F.conv(F.substring(hash_order(cols, seed), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / float(2 ** 32)


def hash_normal(cols, seed: int) -> Column:
    """Standard normal draw by Box-Muller from two hashed uniforms."""
    h = hash_order(cols, seed)
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / float(2 ** 32)
    v = (F.conv(F.substring(h, 9, 8), 16, 10).cast("double") + 0.5) / float(2 ** 32)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * F.pi() * v)


# Stirling series of ln Gamma, coefficients of x^-1, x^-3, x^-5, x^-7.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680]


def ln_gamma(x: str) -> str:
    """SQL text for ln Gamma of a positive SQL expression: recurrence to x + 8, Stirling there."""
    y = f"({x} + 8.0D)"
    product = " * ".join(f"({x} + {i}.0D)" for i in range(8))
    series = " + ".join(f"{c!r}D / pow({y}, {2 * i + 1})" for i, c in enumerate(STIRLING))
    return (f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {series} "
            f"- ln({product}))")
