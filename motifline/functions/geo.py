"""Distances, projections and polygon tests on the sphere, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
KM_PER_KNOT = 1.852

#: The outline of the port area, (longitude, latitude).
BREST_PORT = (
    (-4.407797882145266, 48.382710198105684), (-4.4085430610266165, 48.38941230508402), (-4.410780059125649, 48.39596554138243),
    (-4.414459437657134, 48.40222343444966), (-4.419499438923959, 48.40804606114769), (-4.425787773966339, 48.41330318512496),
    (-4.433184104401638, 48.41787718105243), (-4.441523165405533, 48.421665679069655), (-4.450618461165942, 48.42458386886374),
    (-4.46026644995194, 48.426566410366696), (-4.4702511236245845, 48.427568906943286), (-4.480348876375414, 48.42756890694327),
    (-4.490333550048059, 48.426566410366696), (-4.4999815388340565, 48.42458386886374), (-4.509076834594467, 48.421665679069655),
    (-4.517415895598361, 48.41787718105243), (-4.52481222603366, 48.41330318512496), (-4.53110056107604, 48.40804606114769),
    (-4.536140562342865, 48.40222343444966), (-4.539819940874351, 48.39596554138243), (-4.542056938973382, 48.38941230508402),
    (-4.542802117854734, 48.382710198105684), (-4.5420394146395635, 48.37600896302291), (-4.539786449315992, 48.369458264939745),
    (-4.536094079424156, 48.363204350876714), (-4.531045217000188, 48.357386790420925), (-4.524752938359016, 48.35213536976702),
    (-4.517357932293757, 48.347567207479194), (-4.509025345957496, 48.34378415507323), (-4.499941099863272, 48.340870538994864),
    (-4.4903077539317735, 48.338891292916315), (-4.480340015218268, 48.33789052065888), (-4.470259984781731, 48.33789052065888),
    (-4.460292246068226, 48.338891292916315), (-4.450658900136727, 48.34087053899486), (-4.441574654042504, 48.34378415507323),
    (-4.433242067706241, 48.3475672074792), (-4.425847061640984, 48.35213536976702), (-4.419554782999813, 48.357386790420925),
    (-4.414505920575843, 48.363204350876714), (-4.410813550684008, 48.369458264939745), (-4.408560585360435, 48.37600896302291),
    (-4.407797882145266, 48.382710198105684),
)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def projected(lon: Column, lat: Column, hours: float, knots: Column, heading: Column) -> tuple[Column, Column]:
    """Where a great circle leads, rounded to six decimals; the new latitude is rounded before it gives the longitude."""
    arc, turn, phi = knots * hours * KM_PER_KNOT / RADIUS_KM, F.radians(heading), F.radians(lat)
    new_lat = F.round(F.degrees(F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(turn))), 6)
    east = F.atan2(F.sin(turn) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(F.radians(new_lat)))
    return F.round(F.degrees(F.radians(lon) + east), 6), new_lat


def segment_meets(x1: Column, y1: Column, x2: Column, y2: Column, polygon) -> Column:
    """Does the segment have a point in the closed polygon (vertices in order)?"""
    ring = list(polygon) if tuple(polygon[0]) == tuple(polygon[-1]) else [*polygon, polygon[0]]
    crosses, inside = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):

        def side(px, py, qx, qy, rx, ry):
            return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

        a, b, c, d = F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by)
        s1, s2 = side(x1, y1, x2, y2, a, b), side(x1, y1, x2, y2, c, d)
        s3, s4 = side(a, b, c, d, x1, y1), side(a, b, c, d, x2, y2)
        boxes = (F.least(x1, x2) <= max(ax, bx)) & (F.greatest(x1, x2) >= min(ax, bx)) & (F.least(y1, y2) <= max(ay, by)) & (F.greatest(y1, y2) >= min(ay, by))
        crosses = crosses | (boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0))
        if ay != by:  # a ray to the east from the first point
            hit = ((y1 < ay) != (y1 < by)) & (x1 < ax + (y1 - ay) * ((bx - ax) / (by - ay)))
            inside = inside + hit.cast("int")
    return crosses | (inside % 2 == 1)
