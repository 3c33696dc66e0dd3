"""Speed and direction, east and north components, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speed_direction_to_uv(speed: Column, direction: Column, degrees: bool = False) -> tuple[Column, Column]:
    """East and north components of a speed towards a compass direction (radians, or degrees)."""
    angle = F.radians(direction) if degrees else direction
    return speed * F.sin(angle), speed * F.cos(angle)


def uv_to_speed_direction(u: Column, v: Column, declination: float = 0.0, rotation: float = 0.0) -> tuple[Column, Column]:
    """Speed, and the direction it goes to in degrees clockwise from north (0 to 360)."""
    angle = F.degrees(F.atan2(v, u)) - F.lit(float(declination)) + F.lit(float(rotation))
    return F.hypot(u, v), F.pmod(F.lit(90.0) - angle, F.lit(360.0))


def unit_vector(u: Column, v: Column) -> tuple[Column, Column]:
    """Components of the arrow of length 1 in the same direction."""
    _, direction = uv_to_speed_direction(u, v)
    return speed_direction_to_uv(F.lit(1.0), direction, degrees=True)


def motion_class(velocity: Column, positive_is_towards: bool = True) -> tuple[Column, Column]:
    """-1 or 1 by the sign (zero counts as positive), and whether that is towards or away from the radar."""
    sign = F.when(velocity < 0, -1).otherwise(1)
    return sign, F.when((sign == 1) == F.lit(positive_is_towards), "towards").otherwise("away")


def clipped(velocity: Column, low: float, high: float) -> Column:
    """The velocity within limits (null stays null)."""
    return F.when(velocity.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), velocity)))
