"""Rounding and window arithmetic shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: Column, digits: int = 6) -> Column:
    """Half-even rounding, without a negative zero."""
    return F.bround(c.cast("double"), digits) + F.lit(0.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def array_median(a: Column) -> Column:
    """Interpolating median of an array of numbers (null when empty)."""
    s = F.array_sort(a)
    n = F.size(a)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(
        F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2))


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    Plain projections may be merged into every later reference, which repeats costly
    array and regex work; a generator output never is.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
