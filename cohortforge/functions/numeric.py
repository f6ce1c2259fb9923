"""Numeric column helpers: null handling, rounding and the normal tail."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy_double(col: Column) -> Column:
    """Cast to double and turn NaN into NULL, so aggregates skip it."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(col: Column) -> Column:
    """True for a non-null, non-NaN, non-infinite double."""
    return (
        col.isNotNull()
        & ~F.isnan(col)
        & (F.abs(col) < F.lit(float("inf")))
    )


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL on a zero or NULL denominator."""
    return F.try_divide(top, bottom)


def round_at(col: Column, digits: int = 6) -> Column:
    """Round, and fold negative zero into zero so results compare equal."""
    return F.round(col, digits) + F.lit(0.0)


@F.pandas_udf(T.DoubleType())
def two_sided_normal_p(z: pd.Series) -> pd.Series:
    """Wald p-value of a z statistic; runs on result rows only."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")
