"""Safe arithmetic on counts and proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """``top / bottom`` as double; 0 where the bottom is 0 or either side is missing."""
    top, bottom = _c(top).cast("double"), _c(bottom).cast("double")
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def to_count(text: Column | str) -> Column:
    """Read count held as text to a whole number; unreadable text becomes NULL."""
    return F.round(_c(text).try_cast("double")).try_cast("bigint")


def zero_filled(value: Column | str) -> Column:
    """NULL and NaN to 0."""
    value = _c(value)
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def presence(value: Column | str) -> Column:
    """1 where the value is above zero, otherwise 0 (also for NULL)."""
    return F.coalesce((_c(value) > 0).cast("int"), F.lit(0))


def detections(df: DataFrame, value: str) -> DataFrame:
    """Only rows whose value is above zero."""
    return df.where(F.col(value) > 0)


def label(value: Column | str, digits: int) -> Column:
    """Value rounded for display in a report."""
    return F.round(_c(value), digits)


def logit(p: Column | str) -> Column:
    """Log odds, written as a difference so that both ends stay exact."""
    p = _c(p)
    return F.log(p) - F.log(F.lit(1.0) - p)


def inverse_logit(eta: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(eta)))


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
