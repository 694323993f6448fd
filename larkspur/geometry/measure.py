"""Areas, lengths, centroids, distances, validity and predicates."""

from __future__ import annotations

import numpy as np

from larkspur.geometry import crs
from larkspur.geometry.model import Geometry, bounds, bounds_meet, closed

#: Fixed value: the sphere's radius in metres.
RADIUS = 6371008.8
#: Metres per unit.
METRES = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 0.3048, "nmi": 1852.0}


def shoelace(ring: np.ndarray) -> float:
    """Twice the signed area; positive counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    r = closed(ring) - ring[0]
    return float(np.dot(r[:-1, 0], r[1:, 1]) - np.dot(r[1:, 0], r[:-1, 1]))


def spherical(ring: np.ndarray) -> float:
    r = np.radians(closed(ring))
    return 0.0 if len(ring) < 3 else abs(float(np.sum(np.diff(r[:, 0]) * (np.sin(r[:-1, 1]) + np.sin(r[1:, 1]))))) * RADIUS**2 / 2


def area(g: Geometry, unit: str = "m") -> float:
    """Exteriors less holes: planar, or on the sphere where coordinates are degrees."""
    ring_area = spherical if crs.geographic(g.epsg) else lambda r: abs(shoelace(r)) / 2
    return sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in g.polygons()) / METRES[unit] ** 2


def haversine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between rows of degrees."""
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[:, 1] - a[:, 1]) / 2) ** 2 + np.cos(a[:, 1]) * np.cos(b[:, 1]) * np.sin((b[:, 0] - a[:, 0]) / 2) ** 2
    return 2 * RADIUS * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def length(g: Geometry, unit: str = "m") -> float:
    """The length of lines and the perimeter of polygons, along the sphere where coordinates are degrees."""
    step = haversine if crs.geographic(g.epsg) else lambda a, b: np.hypot(*(b - a).T)
    return float(sum(step(x[:-1], x[1:]).sum() for x in g.lines())) / METRES[unit]


def ring_centroid(ring: np.ndarray) -> np.ndarray:
    r = closed(ring)
    base = r[0]
    r = r - base
    cross = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
    total = cross.sum()
    return base + (r[:-1].mean(0) if total == 0 else ((r[:-1] + r[1:]) * cross[:, None]).sum(0) / (3 * total))


def centroid(g: Geometry) -> np.ndarray | None:
    """Planar: of a polygon's exterior, a line's segments by length, the mean of points; the middle of a collection's bounds."""
    if g.empty():
        return None
    if g.kind == "GeometryCollection":
        b = bounds(g)
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2])
    if polygons := g.polygons():
        weights = np.array([abs(shoelace(p[0])) for p in polygons])
        centres = np.array([ring_centroid(p[0]) for p in polygons])
        return np.average(centres, axis=0, weights=weights) if weights.sum() else centres.mean(0)
    if lines := g.lines():
        a, b = np.concatenate([x[:-1] for x in lines]), np.concatenate([x[1:] for x in lines])
        w = np.hypot(*(b - a).T)
        return np.average((a + b) / 2, axis=0, weights=w) if w.sum() else a.mean(0)
    return g.coordinates().mean(0)


# predicates; boundaries count as touching


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd over all rings of a polygon; on the boundary undefined."""
    out = np.zeros(len(points), bool)
    for r in rings:
        a, b = r[:-1], r[1:]
        y = points[:, 1][:, None]
        straddles = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        out ^= ((points[:, 0][:, None] < x) & straddles).sum(1) % 2 == 1
    return out


def in_polygons(points: np.ndarray, g: Geometry) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for rings in g.polygons():
        out |= inside(points, rings)
    return out


def edges(g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    lines = g.lines()
    return (np.concatenate([x[:-1] for x in lines]), np.concatenate([x[1:] for x in lines])) if lines else (np.zeros((0, 2)), np.zeros((0, 2)))


def cross(o, a, b):
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def segments_meet(a: Geometry, b: Geometry, proper: bool = False) -> bool:
    """Whether any edges share a point; properly: cross inside both."""
    (p, q), (r, s) = edges(a), edges(b)
    if not len(p) or not len(r):
        return False
    p, q, r, s = p[:, None], q[:, None], r[None], s[None]
    d1, d2, d3, d4 = cross(r, s, p), cross(r, s, q), cross(p, q, r), cross(p, q, s)
    hit = (d1 * d2 < 0) & (d3 * d4 < 0)
    if proper or hit.any():
        return bool(hit.any())
    between = lambda d, o, e, x: (d == 0) & (np.minimum(o, e) <= x).all(-1) & (x <= np.maximum(o, e)).all(-1)
    return bool((between(d1, r, s, p) | between(d2, r, s, q) | between(d3, p, q, r) | between(d4, p, q, s)).any())


def segment_distance(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[points, segments] distances."""
    d = b - a
    n = (d * d).sum(1)
    t = np.clip(((points[:, None] - a) * d).sum(-1) / np.where(n == 0, 1, n), 0, 1)
    return np.hypot(*np.moveaxis(points[:, None] - (a + t[..., None] * d), -1, 0))


def on_edges(points: np.ndarray, g: Geometry) -> np.ndarray:
    a, b = edges(g)
    return (segment_distance(points, a, b) == 0).any(1) if len(a) and len(points) else np.zeros(len(points), bool)


def intersects(a: Geometry, b: Geometry) -> bool:
    if not bounds_meet(bounds(a), bounds(b)):
        return False
    for x, y in ((a, b), (b, a)):
        p = x.points()
        if len(p) and (in_polygons(p, y).any() or on_edges(p, y).any() or (len(y.points()) and (p[:, None] == y.points()[None]).all(-1).any())):
            return True
    if segments_meet(a, b):
        return True
    # no edges meet: one lies inside the other, with any vertex of each of its parts
    return any(in_polygons(np.array([line[0] for line in x.lines()]).reshape(-1, 2), y).any() for x, y in ((a, b), (b, a)))


def contains(a: Geometry, b: Geometry) -> bool:
    """Whether all of b lies in a polygonal a; for others, whether b's points are among a's."""
    box, own = bounds(a), bounds(b)
    if not box or not own or not (box[0] <= own[0] and box[1] <= own[1] and own[2] <= box[2] and own[3] <= box[3]):
        return False
    c = b.coordinates()
    if not a.polygons():
        return bool(on_edges(c, a).all()) if a.lines() else bool((c[:, None] == a.points()[None]).all(-1).any(1).all())
    if not (in_polygons(c, a) | on_edges(c, a)).all() or segments_meet(a, b, proper=True):
        return False
    p, q = edges(b)
    middle = (p + q) / 2
    if len(middle) and not (in_polygons(middle, a) | on_edges(middle, a)).all():
        return False
    # a hole of a strictly inside b would be missed by b's own vertices
    holes = [h for rings in a.polygons() for h in rings[1:]]
    return not any(in_polygons(h[:1], b).any() for h in holes)


def within(a: Geometry, b: Geometry) -> bool:
    return contains(b, a)


def disjoint(a: Geometry, b: Geometry) -> bool:
    return not intersects(a, b)


def interiors_meet(a: Geometry, b: Geometry) -> bool:
    if segments_meet(a, b, proper=True):
        return True
    for x, y in ((a, b), (b, a)):
        p, q = edges(x)
        c = np.concatenate([x.coordinates(), (p + q) / 2])
        if len(c) and (in_polygons(c, y) & ~on_edges(c, y)).any():
            return True
    polygons = a.polygons()
    if polygons and b.polygons():  # equal outlines: only the middle tells
        m = np.array([ring_centroid(r[0]) for r in polygons])
        return bool((in_polygons(m, a) & in_polygons(m, b)).any())
    return False


def touches(a: Geometry, b: Geometry) -> bool:
    """They meet, but not inside."""
    return intersects(a, b) and not interiors_meet(a, b) and not (dimension(a) == dimension(b) == 0)


def dimension(g: Geometry) -> int:
    return 2 if g.polygons() else 1 if g.lines() else 0


def overlaps(a: Geometry, b: Geometry) -> bool:
    """Of one dimension, sharing some but neither all of either."""
    if dimension(a) != dimension(b) or not intersects(a, b) or contains(a, b) or contains(b, a):
        return False
    return dimension(a) != 2 or interiors_meet(a, b)


def crosses(a: Geometry, b: Geometry) -> bool:
    """Lines that cut each other, or a line partly inside a polygon."""
    if dimension(a) == dimension(b) == 1:
        return segments_meet(a, b, proper=True)
    if dimension(a) == dimension(b) or not intersects(a, b):
        return False
    small, large = (a, b) if dimension(a) < dimension(b) else (b, a)
    return interiors_meet(small, large) and not contains(large, small)


RELATIONS = {f.__name__: f for f in (intersects, contains, within, disjoint, touches, overlaps, crosses)}


def distance(a: Geometry, b: Geometry, unit: str = "m") -> float | None:
    """The least planar distance, 0 if they meet; of two points in degrees along the sphere."""
    if a.empty() or b.empty():
        return None
    if a.kind == b.kind == "Point" and crs.geographic(a.epsg):
        return float(haversine(a.points(), b.points())[0]) / METRES[unit]
    if a.kind != "Point" or b.kind != "Point":
        if intersects(a, b):
            return 0.0
    best = np.inf
    for x, y in ((a, b), (b, a)):
        p, q = edges(y)
        c = x.coordinates()
        if len(p):
            best = min(best, segment_distance(c, p, q).min())
        elif len(y.points()):
            best = min(best, np.hypot(*np.moveaxis(c[:, None] - y.points(), -1, 0)).min())
    return float(best) / (METRES[unit] if not crs.geographic(a.epsg) else 1.0)


def valid(g: Geometry) -> bool:
    """Finite coordinates, lines of two points, rings of four that close and don't cut themselves, holes inside."""
    for x in g.singles():
        if any(not np.isfinite(c).all() for c in x.arrays()):
            return False
        if x.kind == "LineString" and x.parts and 0 < len(x.parts[0]) < 2:
            return False
        if x.kind == "Polygon":
            for r in x.parts:
                if len(r) < 4 or not (r[0] == r[-1]).all():
                    return False
                ring = Geometry("LineString", [r], False, x.epsg)
                if segments_meet(ring, ring, proper=True):
                    return False
            if x.parts and any(not (inside(h[:, :2], [x.parts[0][:, :2]]) | on_edges(h[:, :2], Geometry("LineString", [x.parts[0]]))).all() for h in x.parts[1:]):
                return False
        if x is not g and not valid(x):
            return False
    return True
