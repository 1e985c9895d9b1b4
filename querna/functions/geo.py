"""Distances, the gazetteer and location scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from querna import constants as K


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * K.EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def near_box(lat: Column, lng: Column, at: tuple[float, float], radius: float) -> Column:
    """A cheap necessary condition that scans can prune by."""
    import math

    dlat = math.degrees(radius / K.EARTH_RADIUS_M) * 1.001
    cos = math.cos(math.radians(min(89.9, abs(at[0]) + dlat)))
    dlng = dlat / max(cos, 1e-3)
    return lat.between(at[0] - dlat, at[0] + dlat) & (lng.between(at[1] - dlng, at[1] + dlng) if abs(at[1]) + dlng < 180 else F.lit(True))


def within(lat: Column, lng: Column, at: tuple[float, float], radius: float) -> Column:
    return near_box(lat, lng, at, radius) & (haversine(lat, lng, F.lit(at[0]), F.lit(at[1])) <= radius)


def location_score(distance: Column, radius: float = K.DEFAULT_RADIUS_M, user_distance: Column | None = None) -> Column:
    """max(0, 1 - d / r), 0.5 where there is no distance; up to 0.3 more for a user within 10 km; 1 at most."""
    s = F.when(distance.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - distance / radius))
    if user_distance is not None:
        s = s + F.when(user_distance <= 10_000, 0.3 * (1 - user_distance / 10_000)).otherwise(0.0)
    return F.least(F.lit(1.0), s)


def coordinate(*sources: Column) -> Column:
    """The first usable coordinate; 0 counts as missing."""
    return F.coalesce(*[F.nullif(s.try_cast("double"), F.lit(0.0)) for s in sources])


def place(name: str) -> tuple[float, float, str] | None:
    return K.GAZETTEER.get(name.lower().strip())


_RADIUS = re.compile(r"(\d+(?:\.\d+)?)\s*(km|kilometers?|miles?|mi|meters?|m)\b", re.I)


def radius_of(query: str) -> float | None:
    """A distance in a query, in metres."""
    m = _RADIUS.search(query)
    if not m:
        return None
    unit = m[2].lower()
    return float(m[1]) * (1000 if unit.startswith("k") else K.MILE_M if unit.startswith("mi") else 1)


def parse_location(query: str, user: tuple[float, float] | None = None) -> dict | None:
    """Where a query asks for: near the user, or in the longest place it names, or at coordinates."""
    q = query.lower()
    if user and re.search(r"\b(?:around|close\s+to|near)\s+me\b", q):
        return {"lat": user[0], "lng": user[1], "radius": radius_of(q) or K.DEFAULT_RADIUS_M, "kind": "user"}
    for name in sorted(K.GAZETTEER, key=len, reverse=True):
        if re.search(rf"\b(?:in|at|within|near)\s+{re.escape(name)}\b", q):
            lat, lng, kind = K.GAZETTEER[name]
            return {"lat": lat, "lng": lng, "radius": radius_of(q) or (K.CITY_RADIUS_M if kind == "city" else K.AREA_RADIUS_M), "kind": kind, "name": name}
    m = re.search(r"([+-]?\d{1,3}\.\d+)[,;\s]+([+-]?\d{1,3}\.\d+)", q)
    if m:
        return {"lat": float(m[1]), "lng": float(m[2]), "radius": radius_of(q[m.end() :]) or K.DEFAULT_RADIUS_M, "kind": "coordinates"}
    return None


def extract_location(lat: Column | None = None, lng: Column | None = None, pair: Column | None = None, point: Column | None = None) -> Column:
    """struct(lat, lng) from plain columns, a [lng, lat] array or a struct with lat and lng; zeros are missing; null without both."""
    lats = [c for c in (lat, F.get(pair, 1) if pair is not None else None, point["lat"] if point is not None else None) if c is not None]
    lngs = [c for c in (lng, F.get(pair, 0) if pair is not None else None, point["lng"] if point is not None else None) if c is not None]
    a, b = coordinate(*lats), coordinate(*lngs)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lng")))


def filter_by_location(hits, where: dict | None, lat: str = "lat", lng: str = "lng", user: tuple[float, float] | None = None):
    """Hits within the radius (all, at 0.5, without a place), with location_score, the best first."""
    at = lambda p: haversine(F.col(lat), F.col(lng), F.lit(p[0]), F.lit(p[1]))
    mine = at(user) if user else None
    if where is None:
        return hits.withColumn("location_score", location_score(F.lit(None).cast("double"), user_distance=mine)).orderBy(F.desc("location_score"), "document_id")
    here = (where["lat"], where["lng"])
    kept = hits.where(within(F.col(lat), F.col(lng), here, where["radius"]))
    return kept.withColumn("location_score", location_score(at(here), where["radius"], mine)).orderBy(F.desc("location_score"), "document_id")


def distance_phrase(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(F.round(metres).cast("int").cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_string("%.1f", metres / 1000), F.lit(" km")))
