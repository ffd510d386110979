"""Points as columns: structs of x, y and, on a sphere, z; longitude and latitude are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def planar_point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def unit_point(lon: Column, lat: Column) -> Column:
    """Unit vector of a longitude and latitude."""
    a, b = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(b) * F.cos(a)).alias("x"), (F.cos(b) * F.sin(a)).alias("y"), F.sin(b).alias("z"))


def lonlat(p: Column) -> Column:
    """Longitude in (-180, 180] and latitude of a unit vector."""
    return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), F.degrees(F.asin(clamp(p["z"]))).alias("lat"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    """Angle between two unit vectors in radians."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.struct((a["x"] / n).alias("x"), (a["y"] / n).alias("y"), (a["z"] / n).alias("z"))


def midpoint(a: Column, b: Column) -> Column:
    """Half way along the great circle."""
    return normalized(F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"), (a["z"] + b["z"]).alias("z")))


def divided(a: Column, b: Column) -> Column:
    """a / b; NaN where b is 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.when(b == 0, 1.0).otherwise(b))
