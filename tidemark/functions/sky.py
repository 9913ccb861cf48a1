"""Sun, moon and wind as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sun_hours(day: Column, lat: float, lon: float, offset_hours: float) -> tuple[Column, Column]:
    """(sunrise, sunset) in hours of the local clock, by the sunrise equation; NULL where the sun stays up or down."""
    n = F.datediff(day, F.lit("2000-01-01"))
    mean = 357.5291 + 0.98560028 * n
    m = F.radians(mean - 360 * F.floor(mean / 360))
    longitude = F.radians(F.degrees(m) + 1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m) + 180 + 102.9372)
    declination = F.asin(F.sin(longitude) * F.sin(F.radians(F.lit(23.4397))))
    noon = 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * longitude) - lon / 360
    here = F.radians(F.lit(lat))
    cosine = (F.sin(F.radians(F.lit(-0.833))) - F.sin(here) * F.sin(declination)) / (F.cos(here) * F.cos(declination))
    half = F.when(F.abs(cosine) <= 1, F.degrees(F.acos(cosine)) / 360)
    return (noon - half) * 24 + 12 + offset_hours, (noon + half) * 24 + 12 + offset_hours


def moon_age(day: Column) -> Column:
    """Share of the synodic month since new moon."""
    months = (F.datediff(day, F.lit("2000-01-01")) - 5.26) / 29.530588853
    return months - F.floor(months)


def onshore_stress(wind: Column) -> Column:
    """The signed square of the wind towards the shore."""
    return F.signum(wind) * wind * wind
