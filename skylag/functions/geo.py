"""Positions on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylag.functions.clock import as_column

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance in kilometres between two points given in degrees."""
    phi1, phi2 = F.radians(as_column(lat1)), F.radians(as_column(lat2))
    half_dphi = (phi2 - phi1) / 2
    half_dlambda = F.radians(as_column(lon2) - as_column(lon1)) / 2
    a = F.pow(F.sin(half_dphi), 2.0) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_dlambda), 2.0)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def unit_vector(lat: Column | str, lon: Column | str) -> tuple[Column, Column, Column]:
    """The point on the unit sphere; straight-line distance grows with great-circle distance."""
    phi, lam = F.radians(as_column(lat)), F.radians(as_column(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)
