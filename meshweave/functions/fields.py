"""Example fields as column expressions of longitude and latitude in degrees.

Published test functions for regridding (Valcke, Piacentini & Jonville 2022).
"""

from __future__ import annotations

from collections.abc import Callable
from math import cos, hypot, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .points import clamp

Field = Callable[[Column, Column], Column]


def longitude_field() -> Field:
    return lambda lon, lat: lon.cast("double")


def sinusoid_field(dp_length: float = 1.2 * pi, coef: float = 2.0, coefmult: float = 1.0) -> Field:
    def value(lon: Column, lat: Column) -> Column:
        angle = F.acos(clamp(F.cos(F.radians(lon)) * F.cos(F.radians(lat))))
        return F.lit(coefmult) * (F.lit(coef) - F.cos(angle * F.lit(pi / dp_length)))

    return value


def harmonic_field() -> Field:
    return lambda lon, lat: 2 + F.pow(F.sin(2 * F.radians(lat)), F.lit(16.0)) * F.cos(16 * F.radians(lon))


def gulf_stream_field(dp_length: float = 1.2 * pi, coef: float = 2.0, strength: float = 1.0, origin: tuple[float, float] = (-80.0, 25.0), end: tuple[float, float] = (-1.8, 50.0), damping: tuple[float, float] = (-25.5, 55.5)) -> Field:
    """A sinusoid with a narrow current that leaves ``origin``, weakens from ``damping`` on and stops at ``end``."""
    rad = pi / 180
    far = hypot((end[0] - origin[0]) * rad, (end[1] - origin[1]) * rad)
    near = hypot((damping[0] - origin[0]) * rad, (damping[1] - origin[1]) * rad)

    def value(lon: Column, lat: Column) -> Column:
        wrapped = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
        dx, dy = (wrapped - origin[0]) * rad, (lat - origin[1]) * rad
        r, theta = F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx)
        weight = F.when(r > far, 0.0).when(r > near, 1.3 * strength * F.cos(pi * 0.5 * (r - near) / (far - near))).otherwise(1.3 * strength)
        wave = 1000.0 * F.sin(0.4 * (0.5 * r + theta) + 0.007 * F.cos(50.0 * theta) + 0.37 * pi)
        return sinusoid_field(dp_length, coef)(lon, lat) + (F.greatest(wave, F.lit(999.0)) - 999.0) * weight

    return value


def vortex_field(lon0: float = 5.5, lat0: float = 0.2, r0: float = 3.0, d: float = 5.0, t: float = 6.0) -> Field:
    """Two spirals around the pole (lon0, lat0), in radians, of a turned sphere."""

    def value(lon: Column, lat: Column) -> Column:
        b, turn = F.radians(lat), F.radians(lon) - lon0
        across = F.cos(b) * F.cos(turn)
        x = sin(lat0) * across - cos(lat0) * F.sin(b)
        y = F.cos(b) * F.sin(turn)
        z = sin(lat0) * F.sin(b) + cos(lat0) * across
        angle = F.atan2(y, x)
        angle = F.when(angle < 0, angle + 2 * pi).otherwise(angle)
        rho = r0 * F.cos(F.asin(clamp(z)))
        speed = F.lit(3 * sqrt(3) / 2) / F.pow(F.cosh(rho), F.lit(2.0)) * F.tanh(rho)
        omega = F.when(rho == 0, 0.0).otherwise(speed / F.when(rho == 0, 1.0).otherwise(rho))
        return 2 * (1 + F.tanh(rho / d * F.sin(angle - omega * t)))

    return value
