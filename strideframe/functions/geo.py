"""Geometry and geodesy as native columns.

Points are ``struct<x,y>``, lines ``array<struct<x,y>>`` and plain polygons one
open ring in the same array type. Polygons with holes or several parts are
``parts``: an array of parts, each an array of rings, the outline first and its
holes after it. Nothing here leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

EARTH_R = 6371000.0


# --- spherical ---------------------------------------------------------------

def haversine(lng1, lat1, lng2, lat2) -> Column:
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_R * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lng1, lat1, lng2, lat2) -> Column:
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    dl = F.radians(lng2 - lng1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_gap(a, b) -> Column:
    """Smallest angle between two headings in degrees."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def destination(lng, lat, distance, heading) -> Column:
    """Point reached from (lng, lat) after ``distance`` metres on ``heading``."""
    lng, lat, distance, heading = map(col, (lng, lat, distance, heading))
    br, p1, ang = F.radians(heading), F.radians(lat), distance / EARTH_R
    p2 = F.asin(F.sin(p1) * F.cos(ang) + F.cos(p1) * F.sin(ang) * F.cos(br))
    l2 = F.radians(lng) + F.atan2(
        F.sin(br) * F.sin(ang) * F.cos(p1), F.cos(ang) - F.sin(p1) * F.sin(p2)
    )
    return F.struct(
        (F.pmod(F.degrees(l2) + 540.0, F.lit(360.0)) - 180.0).alias("lng"),
        F.degrees(p2).alias("lat"),
    )


def metre_delta(lng1, lat1, lng2, lat2) -> tuple[Column, Column]:
    """East and north metres between two close points."""
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    squeeze = F.greatest(F.lit(0.2), F.cos(F.radians(lat1)))
    return (lng2 - lng1) * 111320.0 * squeeze, (lat2 - lat1) * 111320.0


# --- transverse Mercator (Krueger series, GRS80, zone 55 south) ---------------
# Fixed values of the ellipsoid and the map zone.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
ZONE_K0 = 0.9996
ZONE_FALSE_E = 500000.0
ZONE_FALSE_N = 10000000.0
ZONE_LON0 = 147.0

_n = GRS80_F / (2 - GRS80_F)
_A = GRS80_A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
_BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
_DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)
_E2 = 2 * math.sqrt(_n) / (1 + _n)


def to_metric(lng, lat) -> Column:
    """Longitude and latitude to eastings and northings."""
    lng, lat = col(lng), col(lat)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(_E2) * F.atanh(F.lit(_E2) * s))
    dl = F.radians(lng - ZONE_LON0)
    xi0 = F.atan2(t, F.cos(dl))
    eta0 = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(_ALPHA, 1):
        xi = xi + F.lit(a) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + F.lit(a) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return F.struct(
        (ZONE_FALSE_E + ZONE_K0 * _A * eta).alias("x"), (ZONE_FALSE_N + ZONE_K0 * _A * xi).alias("y")
    )


def to_lonlat(x, y) -> Column:
    """Eastings and northings back to longitude and latitude."""
    x, y = col(x), col(y)
    xi0 = (y - ZONE_FALSE_N) / (ZONE_K0 * _A)
    eta0 = (x - ZONE_FALSE_E) / (ZONE_K0 * _A)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - F.lit(b) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    return F.struct(
        (ZONE_LON0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lng"),
        F.degrees(lat).alias("lat"),
    )


# --- planar ------------------------------------------------------------------

def span(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def point_piece_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from a straight piece."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(
        len2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / len2))
    ).otherwise(0.0)
    return span(px - (x1 + t * dx), py - (y1 + t * dy))


def pieces_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two straight pieces meet at a point inside both (or touch without being parallel)."""
    ax, ay, bx, by, cx, cy, dx, dy = map(col, (ax, ay, bx, by, cx, cy, dx, dy))
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    den = ux * vy - uy * vx
    s = F.try_divide((cx - ax) * vy - (cy - ay) * vx, den)
    t = F.try_divide((cx - ax) * uy - (cy - ay) * ux, den)
    return F.coalesce((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), F.lit(False))


def piece_piece_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance between two straight pieces."""
    ends = F.least(
        point_piece_distance(ax, ay, cx, cy, dx, dy),
        point_piece_distance(bx, by, cx, cy, dx, dy),
        point_piece_distance(cx, cy, ax, ay, bx, by),
        point_piece_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(pieces_cross(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(ends)


def line_edges(line: Column) -> Column:
    """Consecutive vertex pairs of a line."""
    n = F.size(line)
    return F.when(
        n >= 2,
        F.zip_with(
            F.slice(line, F.lit(1), n - 1),
            F.slice(line, F.lit(2), n - 1),
            lambda p, q: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
            ),
        ),
    )


def ring_edges(ring: Column) -> Column:
    """Sides of an open ring, the closing side included."""
    return line_edges(F.concat(ring, F.slice(ring, 1, 1)))


def in_ring(edges: Column, px: Column, py: Column) -> Column:
    """Crossing-number test with a half-open y rule, so shared corners count once."""
    hits = F.filter(
        edges,
        lambda e: ((e["y1"] > py) != (e["y2"] > py))
        & (px < e["x1"] + F.coalesce(F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"]), F.lit(0.0))),
    )
    return F.size(hits) % 2 == 1


def ring_point_distance(edges: Column, px: Column, py: Column) -> Column:
    """0 inside the ring, else the distance to its nearest side."""
    side = F.array_min(
        F.transform(edges, lambda e: point_piece_distance(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))
    )
    return F.when(in_ring(edges, px, py), 0.0).otherwise(side)


def ring_piece_distance(edges: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """0 when the piece starts inside or meets a side, else the gap between them."""
    side = F.array_min(
        F.transform(
            edges, lambda e: piece_piece_distance(ax, ay, bx, by, e["x1"], e["y1"], e["x2"], e["y2"])
        )
    )
    return F.when(in_ring(edges, ax, ay), 0.0).otherwise(side)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an open ring."""
    return F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2,
    )


def parts_area(parts: Column) -> Column:
    """Area of all parts, holes taken off; rings may turn either way."""
    def one(part):
        rings = F.transform(part, lambda r: F.abs(ring_area(r)))
        return 2 * rings[0] - F.aggregate(rings, F.lit(0.0), lambda acc, a: acc + a)

    return F.aggregate(F.transform(F.filter(parts, lambda p: F.size(p) > 0), one), F.lit(0.0), lambda acc, a: acc + a)


def parts_centroid(parts: Column) -> Column:
    """Centre of gravity of all parts, holes taken off; NULL without area."""
    def moments(ring):
        m = F.aggregate(
            ring_edges(ring), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
            lambda acc, e: F.struct(
                (acc["a"] + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2).alias("a"),
                (acc["x"] + (e["x1"] + e["x2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 6).alias("x"),
                (acc["y"] + (e["y1"] + e["y2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 6).alias("y")))
        return m

    def signed(part):
        def one(ring, i):
            m = moments(ring)
            turn = F.when((m["a"] >= 0) == (i == 0), 1.0).otherwise(-1.0)
            return F.struct((m["a"] * turn).alias("a"), (m["x"] * turn).alias("x"), (m["y"] * turn).alias("y"))

        return F.transform(part, one)

    total = F.aggregate(
        F.flatten(F.transform(parts, signed)), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda acc, m: F.struct((acc["a"] + m["a"]).alias("a"), (acc["x"] + m["x"]).alias("x"), (acc["y"] + m["y"]).alias("y")),
        lambda t: F.struct(F.try_divide(t["x"], t["a"]).alias("x"), F.try_divide(t["y"], t["a"]).alias("y")))
    return total


def parts_bounds(parts: Column) -> dict[str, Column]:
    """Bounding box columns of all parts."""
    return coord_bounds(F.flatten(F.transform(parts, lambda p: F.flatten(p))))


def in_parts(parts: Column, px: Column, py: Column) -> Column:
    """Whether a point lies inside the outline of some part and in none of its holes."""
    def one(part):
        inside = F.transform(part, lambda r: in_ring(ring_edges(r), px, py))
        return F.size(part).__gt__(0) & inside[0] & ~F.exists(F.slice(inside, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda x: x)

    return F.exists(parts, one)


def line_length(line: Column) -> Column:
    return F.aggregate(
        line_edges(line),
        F.lit(0.0),
        lambda acc, e: acc + span(e["x2"] - e["x1"], e["y2"] - e["y1"]),
    )


def coord_bounds(coords: Column) -> dict[str, Column]:
    """Bounding box columns of a line or ring."""
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return {
        "minx": F.array_min(xs),
        "miny": F.array_min(ys),
        "maxx": F.array_max(xs),
        "maxy": F.array_max(ys),
    }


def box_ring(minx, miny, maxx, maxy) -> Column:
    minx, miny, maxx, maxy = map(col, (minx, miny, maxx, maxy))

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(pt(minx, miny), pt(maxx, miny), pt(maxx, maxy), pt(minx, maxy))


# --- intervals on a piece ----------------------------------------------------

def capsule_interval(ax, ay, bx, by, x1, y1, x2, y2, r) -> Column:
    """Share of piece a-b that lies within ``r`` of piece 1-2, as ``struct<lo,hi>`` of t in [0,1].

    The set within ``r`` of a piece is convex, so one interval says it all: the
    union of what the two end discs and the strip between them cut out.
    """
    ax, ay, bx, by, x1, y1, x2, y2 = map(col, (ax, ay, bx, by, x1, y1, x2, y2))
    r = F.lit(float(r)) if not isinstance(r, Column) else r
    ux, uy = bx - ax, by - ay
    uu = ux * ux + uy * uy

    def disc(cx, cy):
        fx, fy = ax - cx, ay - cy
        b = fx * ux + fy * uy
        d = b * b - uu * (fx * fx + fy * fy - r * r)
        root = F.sqrt(F.greatest(d, F.lit(0.0)))
        lo, hi = F.try_divide(-b - root, uu), F.try_divide(-b + root, uu)
        ok = (d >= 0) & (hi >= 0) & (lo <= 1)
        return F.when(ok, F.greatest(lo, F.lit(0.0))), F.when(ok, F.least(hi, F.lit(1.0)))

    vx, vy = x2 - x1, y2 - y1
    vv = vx * vx + vy * vy
    # along: 0 <= ((a + t u) - p1).v <= vv ; across: |cross| <= r sqrt(vv)
    along0, along_u = (ax - x1) * vx + (ay - y1) * vy, ux * vx + uy * vy
    cross0, cross_u = (ax - x1) * vy - (ay - y1) * vx, ux * vy - uy * vx
    wide = r * F.sqrt(vv)

    def slab(c0, cu, lo, hi):
        """t range with lo <= c0 + t cu <= hi."""
        t1, t2 = F.try_divide(lo - c0, cu), F.try_divide(hi - c0, cu)
        flat = (c0 >= lo) & (c0 <= hi)
        return (
            F.when(cu != 0, F.least(t1, t2)).when(flat, F.lit(0.0)).otherwise(F.lit(2.0)),
            F.when(cu != 0, F.greatest(t1, t2)).when(flat, F.lit(1.0)).otherwise(F.lit(-1.0)),
        )

    s1, s2 = slab(along0, along_u, F.lit(0.0), vv), slab(cross0, cross_u, -wide, wide)
    slo = F.greatest(s1[0], s2[0], F.lit(0.0))
    shi = F.least(s1[1], s2[1], F.lit(1.0))
    strip_ok = (vv > 0) & (slo <= shi)
    d1, d2 = disc(x1, y1), disc(x2, y2)
    lo = F.least(d1[0], d2[0], F.when(strip_ok, slo))
    hi = F.greatest(d1[1], d2[1], F.when(strip_ok, shi))
    return F.when(lo.isNotNull() & (hi > lo), F.struct(lo.alias("lo"), hi.alias("hi")))


def inside_intervals(edges: Column, ax, ay, bx, by) -> Column:
    """Parts of piece a-b inside a ring, as an array of t intervals."""
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    ux, uy = bx - ax, by - ay

    def cut(e):
        den = ux * (e["y2"] - e["y1"]) - uy * (e["x2"] - e["x1"])
        t = F.try_divide((e["x1"] - ax) * (e["y2"] - e["y1"]) - (e["y1"] - ay) * (e["x2"] - e["x1"]), den)
        s = F.try_divide((e["x1"] - ax) * uy - (e["y1"] - ay) * ux, den)
        return F.when((t > 0) & (t < 1) & (s >= 0) & (s <= 1), t)

    cuts = F.array_sort(
        F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform(edges, cut), lambda t: t.isNotNull()))
    )
    gaps = F.zip_with(
        F.slice(cuts, F.lit(1), F.size(cuts) - 1),
        F.slice(cuts, F.lit(2), F.size(cuts) - 1),
        lambda a, b: F.struct(a.alias("lo"), b.alias("hi")),
    )
    return F.filter(
        gaps,
        lambda g: (g["hi"] > g["lo"])
        & in_ring(edges, ax + (g["lo"] + g["hi"]) / 2 * ux, ay + (g["lo"] + g["hi"]) / 2 * uy),
    )


def corridor_intervals(edges: Column, ax, ay, bx, by, r) -> Column:
    """Parts of piece a-b inside a ring or within ``r`` of its sides."""
    caps = F.filter(
        F.transform(edges, lambda e: capsule_interval(ax, ay, bx, by, e["x1"], e["y1"], e["x2"], e["y2"], r)),
        lambda g: g.isNotNull(),
    )
    return F.concat(caps, inside_intervals(edges, ax, ay, bx, by))


def merged_length(intervals: Column) -> Column:
    """Length of the union of an array of intervals."""
    start = F.struct(F.lit(-1e308).alias("reach"), F.lit(0.0).alias("total"))
    done = F.aggregate(
        F.array_sort(intervals),
        start,
        lambda acc, g: F.struct(
            F.greatest(acc["reach"], g["hi"]).alias("reach"),
            (
                acc["total"] + F.greatest(F.lit(0.0), g["hi"] - F.greatest(acc["reach"], g["lo"]))
            ).alias("total"),
        ),
    )
    return done["total"]
