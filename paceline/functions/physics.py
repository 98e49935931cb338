"""Distances on the earth, weather and training formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points; null where a coordinate is (least() would skip it)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def celsius(text: Column) -> Column:
    """'24 degC' or '75 degF' in degrees Celsius."""
    value = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(text.rlike("(?i)degF"), (value - 32) * 5 / 9).otherwise(value)


def humidity_percent(x: Column) -> Column:
    """Shares of up to 1, and hundredths of percents, as percents."""
    return F.when(x <= 1, x * 100).when(x > 100, x / 100).otherwise(x)


#: Magnus formula.
MAGNUS = (17.625, 243.04)
#: Heat index regression, in Fahrenheit and percent.
HEAT_INDEX = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783, -0.05481717, 0.00122874, 0.00085282, -0.00000199)


def dew_point(temp_c: Column, humidity: Column) -> Column:
    b, c = MAGNUS
    g = F.log(humidity / 100) + b * temp_c / (c + temp_c)
    return c * g / (b - g)


def heat_index(temp_c: Column, humidity: Column) -> Column:
    """Felt temperature in Celsius; null below 80 F or 40 %."""
    t, r = temp_c * 9 / 5 + 32, humidity
    k = HEAT_INDEX
    f = k[0] + k[1] * t + k[2] * r + k[3] * t * r + k[4] * t * t + k[5] * r * r + k[6] * t * t * r + k[7] * t * r * r + k[8] * t * t * r * r
    return F.when((t >= 80) & (r >= 40), (f - 32) * 5 / 9)


def training_impulse(minutes: Column, hr: Column, rest: Column, max_hr: Column, female: Column) -> Column:
    """Minutes x reserve fraction x 0.64 x exp(k x fraction); null without a usable heart rate."""
    f = F.least(F.lit(1.0), (hr - rest) / (max_hr - rest))
    k = F.when(female, 1.67).otherwise(1.92)
    return F.when((minutes > 0) & (hr > rest) & (max_hr > rest), minutes * f * 0.64 * F.exp(k * f))


def load(minutes: Column, hr: Column, rest: Column, max_hr: Column, female: Column, effort: Column) -> Column:
    """The impulse, or else effort x minutes x 0.3, or else 0."""
    return F.coalesce(training_impulse(minutes, hr, rest, max_hr, female), F.when(minutes > 0, effort * minutes * 0.3), F.lit(0.0))


def expected_max_hr(age: Column) -> Column:
    return 208 - 0.7 * age


def zone_bounds(max_hr: float | None = None, custom: list[float] | None = None) -> list[float]:
    """Four upper limits: 60, 70, 80 and 90 % of a maximum, or four increasing numbers."""
    if custom is not None:
        if len(custom) != 4 or any(b <= 0 for b in custom) or any(a >= b for a, b in zip(custom, custom[1:], strict=False)):
            raise ValueError("bounds must be 4 increasing positive numbers")
        return list(custom)
    if max_hr is None:
        raise ValueError("a maximum or bounds are needed")
    return [float(int(max_hr * p / 100 + 0.5)) for p in (60, 70, 80, 90)]


def in_zone(value: Column, bounds: list[float]) -> Column:
    """1 below the first bound, up to len(bounds) + 1 from the last one."""
    return sum((F.when(value >= b, 1).otherwise(0) for b in bounds), F.lit(1))
