"""Geodesics on the WGS84 ellipsoid (Vincenty's series), as Arrow-batched functions over columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
STEPS = 12


def _series(cos2_alpha):
    u2 = cos2_alpha * (MAJOR**2 - MINOR**2) / MINOR**2
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big_a, big_b


def _delta(big_b, sin_s, cos_s, mid):
    inner = cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)
    return big_b * sin_s * (mid + big_b / 4 * inner)


def forward(lon, lat, azimuth, km, steps: int = STEPS):
    """End point (lon, lat) of the geodesic that starts at an azimuth and is ``km`` long; numpy arrays in degrees."""
    a1, s = np.radians(azimuth), np.asarray(km, dtype=float) * 1000
    tan_u = (1 - FLATTENING) * np.tan(np.radians(lat))
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u = tan_u * cos_u
    start = np.arctan2(tan_u, np.cos(a1))
    sin_a = cos_u * np.sin(a1)
    cos2_a = 1 - sin_a**2
    big_a, big_b = _series(cos2_a)
    first = s / (MINOR * big_a)
    sigma = first
    for _ in range(steps):
        sigma = first + _delta(big_b, np.sin(sigma), np.cos(sigma), np.cos(2 * start + sigma))
    mid, sin_s, cos_s = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
    across = sin_u * sin_s - cos_u * cos_s * np.cos(a1)
    lat2 = np.arctan2(sin_u * cos_s + cos_u * sin_s * np.cos(a1), (1 - FLATTENING) * np.sqrt(sin_a**2 + across**2))
    lam = np.arctan2(sin_s * np.sin(a1), cos_u * cos_s - sin_u * sin_s * np.cos(a1))
    c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
    turn = lam - (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
    return np.asarray(lon, dtype=float) + np.degrees(turn), np.degrees(lat2)


def backward(lon1, lat1, lon2, lat2, steps: int = STEPS):
    """Azimuth from point 1 to 2, azimuth from 2 to 1 (both 0 to 360) and distance in km; equal points: 0, 180, 0."""
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    sin1, cos1, sin2, cos2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    apart = np.radians(np.asarray(lon2, dtype=float) - np.asarray(lon1, dtype=float))
    lam = apart
    for _ in range(steps + 1):
        sin_s = np.hypot(cos2 * np.sin(lam), cos1 * sin2 - sin1 * cos2 * np.cos(lam))
        cos_s = sin1 * sin2 + cos1 * cos2 * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        same = sin_s == 0
        sin_a = np.where(same, 0.0, cos1 * cos2 * np.sin(lam) / np.where(same, 1.0, sin_s))
        cos2_a = 1 - sin_a**2
        level = cos2_a == 0
        mid = np.where(level, 0.0, cos_s - 2 * sin1 * sin2 / np.where(level, 1.0, cos2_a))
        c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
        used = lam
        lam = apart + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
    big_a, big_b = _series(cos2_a)
    km = MINOR * big_a * (sigma - _delta(big_b, sin_s, cos_s, mid)) / 1000
    ahead = np.degrees(np.arctan2(cos2 * np.sin(used), cos1 * sin2 - sin1 * cos2 * np.cos(used)))
    onward = np.degrees(np.arctan2(cos1 * np.sin(used), cos1 * sin2 * np.cos(used) - sin1 * cos2))
    return np.mod(ahead, 360), np.mod(onward + 180, 360), km


def reckon(lon: Column, lat: Column, azimuth: Column, km: Column) -> Column:
    """struct<lon, lat>: the point ``km`` away in the direction of the azimuth."""

    @F.pandas_udf("lon double, lat double")
    def run(x: pd.Series, y: pd.Series, a: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lon", "lat"), forward(x, y, a, d), strict=True)))

    return run(*(c.cast("double") for c in (lon, lat, azimuth, km)))


def inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """struct<azimuth, back_azimuth, km> between two points."""

    @F.pandas_udf("azimuth double, back_azimuth double, km double")
    def run(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        found = backward(*(s.to_numpy(dtype=float) for s in (x1, y1, x2, y2)))
        return pd.DataFrame(dict(zip(("azimuth", "back_azimuth", "km"), found, strict=True)))

    return run(*(c.cast("double") for c in (lon1, lat1, lon2, lat2)))
