"""Distance, box and grid expressions over coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import GRID_STEP, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp = F.sin((p2 - p1) / 2)
    dl = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return dp * dp + F.cos(p1) * F.cos(p2) * dl * dl


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, arcsine form."""
    return F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2))) * (2 * EARTH_RADIUS_KM)


def haversine_atan_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, two-argument arctangent form."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_KM)


def euclid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight distance in degrees, turned into kilometres."""
    dx, dy = lat2 - lat1, lon2 - lon1
    return F.sqrt(dx * dx + dy * dy) * KM_PER_DEGREE


def in_city(lat: Column, lon: Column, lon_min: float = LON_MIN) -> Column:
    """City box, both ends inclusive; NULL and NaN never pass."""
    return lat.between(LAT_MIN, LAT_MAX) & lon.between(lon_min, LON_MAX)


def in_world(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def grid_index(value: Column, origin: float, step: float = GRID_STEP) -> Column:
    """Cell number; truncation toward zero, as an integer cast does."""
    return ((value - F.lit(origin)) / F.lit(step)).cast("int")


def equal_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of ``bins`` equal widths over [low, high]; last bin closed.

    The quotient is rounded at 9 digits first, so that a value which sits on an
    edge falls into the bin that starts there whatever the last bit says.
    """
    if high is None or low is None:
        return F.lit(None).cast("int")
    if high == low:
        return F.when(value.isNotNull(), F.lit(0))
    pos = F.floor(F.round((value - F.lit(low)) / F.lit(high - low) * F.lit(float(bins)), 9))
    return F.least(F.greatest(pos, F.lit(0)), F.lit(bins - 1)).cast("int")
