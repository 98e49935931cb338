"""Rounding, formatting and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half toward positive infinity; null and NaN give null."""
    scale = float(10**digits)
    y = F.floor(x * scale + 0.5).cast("double") / scale
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), y)


def tidy(x: Column) -> Column:
    """No digits from 1000, one from 10, two below."""
    a = F.abs(x)
    return F.when(a >= 1000, half_up(x, 0)).when(a >= 10, half_up(x, 1)).otherwise(half_up(x, 2))


def hms(seconds: Column) -> Column:
    """h:mm:ss."""
    s = F.floor(seconds + 0.5).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def pace(seconds: Column) -> Column:
    """m:ss."""
    s = F.floor(seconds + 0.5).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def goal_seconds(text: Column) -> Column:
    """h:mm:ss (or h:mm) as seconds; null outside 600 to 86400."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2}):([0-5]\d)(?::([0-5]\d))?\s*$", i)
    s = part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + F.coalesce(part(3).try_cast("int"), F.lit(0))
    return F.when(s.between(600, 86400), s)


#: The rational approximation 7.1.26 of the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to 1e-7."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x < 0, (1 - erf) / 2).otherwise((1 + erf) / 2)


def coefficient_of_variation(x: Column) -> Column:
    """Sample deviation over mean, as an aggregate."""
    return F.when(F.avg(x) != 0, F.stddev_samp(x) / F.avg(x))
