"""Geometry as built-in Column expressions; everything here stays in generated JVM code.

Coordinates are WGS84 degrees.  Fixed values: sphere radius of distance and
mercator area 6 371 000 m, latitude limit of the mercator plane 85.05112878.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6371000.0
MAX_LAT = 85.05112878


def mercator_y(lat: Column) -> Column:
    """Unit-sphere mercator ordinate, latitude clamped to the plane's limit."""
    held = F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(held) / 2))


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Mercator area of an axis-aligned box in square metres (inflated by latitude, as defined)."""
    return F.lit(EARTH_RADIUS * EARTH_RADIUS) * F.radians(east - west) * (mercator_y(north) - mercator_y(south))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres by the atan2 form."""
    return arc(half_chord(lon1, lat1, lon2, lat2))


def half_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Square of half the chord between two points of the unit sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)


def arc(h: Column) -> Column:
    """Great-circle metres of a squared half chord, which is named twice."""
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1.0) - h, F.lit(0.0))))  # antipodes may round above 1


def distance(lon1: Column, lat1: Column, z1: Column, lon2: Column, lat2: Column, z2: Column) -> Column:
    """Great-circle metres and the difference of heights together; an unknown height is 0."""
    return F.hypot(haversine(lon1, lat1, lon2, lat2), F.coalesce(z2, F.lit(0.0)) - F.coalesce(z1, F.lit(0.0)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees from -180 to 180."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 540, F.lit(360.0)) - 180


def destination(lon: Column, lat: Column, metres: Column, bearing_deg: Column) -> Column:
    """Struct (lon, lat) of the point that many metres away; longitude normalised to -180..180."""
    d, b = metres / F.lit(EARTH_RADIUS), F.radians(bearing_deg)
    phi = F.radians(lat)
    sin2 = F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b)
    lam = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * sin2)
    return F.struct((F.pmod(F.degrees(lam) + 540, F.lit(360.0)) - 180).alias("lon"), F.degrees(F.asin(sin2)).alias("lat"))


def box_union(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {"west": F.least(a["west"], b["west"]), "south": F.least(a["south"], b["south"]), "east": F.greatest(a["east"], b["east"]), "north": F.greatest(a["north"], b["north"])}


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Common box; null where they don't meet (touching edges give a degenerate box)."""
    c = {"west": F.greatest(a["west"], b["west"]), "south": F.greatest(a["south"], b["south"]), "east": F.least(a["east"], b["east"]), "north": F.least(a["north"], b["north"])}
    meet = (c["west"] <= c["east"]) & (c["south"] <= c["north"])
    return {k: F.when(meet, v) for k, v in c.items()}
