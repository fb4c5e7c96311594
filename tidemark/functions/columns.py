"""Column-level helpers shared by the operators. Everything here is a pure
``Column -> Column`` function built from Spark's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """Missing floats become NULL at the edge: ``NaN > x`` is true in Spark."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with a zero or missing denominator giving NULL."""
    num, den = as_col(num), as_col(den)
    return F.when(den != 0, num / den)


def growth(now: Column | str, before: Column | str) -> Column:
    return ratio(now, before) - 1


def strictly(c: Column | str) -> Column:
    """Three-valued flag to two-valued gate: only TRUE passes."""
    return F.coalesce(as_col(c), F.lit(False))


def all_true(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [strictly(c) for c in cols])


def votes(cols: list[Column]) -> Column:
    """How many of the flags are TRUE (NULL and FALSE count nothing)."""
    return reduce(lambda a, b: a + b, [strictly(c).cast("bigint") for c in cols])


def row_mean(cols: list[Column]) -> Column:
    """Mean of the non-null columns of a row; NULL when all are NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(known > 0, total / known)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def effective_tax(tax: Column, pretax: Column, sign: int = 1,
                  default: float = 0.21, ceiling: float = 0.6) -> Column:
    """Tax over pre-tax income inside [0, ceiling]; ``sign=-1`` for sources
    that report the expense as a negative number."""
    known = (F.abs(pretax) > 1e-6) & tax.isNotNull()
    return F.when(known, clamp(sign * tax / pretax, 0.0, ceiling)).otherwise(F.lit(default))


def total_debt(long_term: Column, short_term: Column) -> Column:
    return F.coalesce(long_term, F.lit(0.0)) + F.coalesce(short_term, F.lit(0.0))


def parse_money(c: Column | str) -> Column:
    """``+$1,234`` to 1234.0; unparsable text to NULL."""
    return F.regexp_replace(as_col(c), "[$,+\\s]", "").try_cast("double")


def quarter_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", as_col(d)), 2))


def quarter_label(d: Column | str) -> Column:
    d = as_col(d)
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))


def to_provider_symbol(c: Column | str) -> Column:
    return F.translate(F.upper(F.trim(as_col(c))), ".", "-")


def from_provider_symbol(c: Column | str) -> Column:
    return F.translate(as_col(c), "-", ".")


def array_percentile(values: Column, q: float) -> Column:
    """Linear-interpolated percentile of a small array column."""
    s = F.array_sort(values)
    pos = (F.size(values) - 1) * F.lit(q)
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    a, b = F.get(s, lo), F.get(s, hi)
    return F.when(F.size(values) > 0, a + (b - a) * (pos - lo))


def order_bin(v: Column | str, per_octave: int = 64) -> Column:
    """Order-preserving bucket of a double, about one percent wide.

    Equal values share a bucket and a larger value never gets a smaller one,
    so a group of any size can be ranked bucket by bucket. It depends on the
    value alone, hence a re-run task assigns the same bucket again.
    """
    v = as_col(v).cast("double")
    size = F.floor(F.log2(F.abs(v)) * per_octave) + F.lit(1 << 17)
    return F.when(v > 0, size).when(v < 0, -size).when(v == 0, F.lit(0)).cast("bigint")


def spread(c: Column | str, digits: int = 1) -> Column:
    """Leading hex digits of the key's md5: a stable salt that keeps md5 order."""
    return F.substring(F.md5(as_col(c).cast("string")), 1, digits)
